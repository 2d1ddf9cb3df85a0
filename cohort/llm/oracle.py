"""The queries that SQL can express, in DuckDB SQL over the same tables."""

from __future__ import annotations

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.text) AS text_sha256 FROM d JOIN g ON d.text = g.text
"""

#: Words of 8-word windows that occur twice or more: the union of their positions.
QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
hot AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM hot WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words
         FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Lu}')) AS capitals FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10))) OR 10 * len(regexp_extract_all(text, '[!?]{2,}')) > n_words
            OR 2 * letters < word_chars OR 2 * capitals > letters) AS kept
FROM f
"""

#: Water filling: sources in order of cap / weight fill up one after another until the level fits.
MIXING = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CAST(k % 3 + 1 AS DOUBLE) AS weight, 3.0 * source_size / (k % 3 + 1) AS full_at FROM s WHERE source_size > 0),
c AS (SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(3.0 * source_size) OVER o, 0) AS rest,
             (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS open_weight
      FROM w WINDOW o AS (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(rest / open_weight, full_at) AS least FROM c WHERE full_at >= rest / open_weight),
t AS (SELECT s.source, s.source_size, s.k, CASE WHEN s.source_size = 0 THEN 0.0 WHEN 3.0 * s.source_size < weight * least THEN 3.0 * s.source_size ELSE weight * least END AS target
      FROM s LEFT JOIN w ON s.k = w.k CROSS JOIN level),
g AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS goal FROM t),
p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.goal, g.k,
             coalesce(sum(d.size) OVER (PARTITION BY g.k ORDER BY md5('mix:' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN size * (goal // source_size) + greatest(0, least(size, goal - (goal // source_size) * source_size - start)) ELSE 0 END AS taken FROM p),
seg AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 1.5, -1.0), (1, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 0.5, 0.5), (2, 0.5, 0.3125, 0.75, 2.5)) v(kind, t0, share, rate, slope)),
z AS (SELECT q.*, t0, share * q.target AS before_, rate * q.target AS r, slope * q.target AS sl,
             row_number() OVER (PARTITION BY q.k, q.doc_id ORDER BY t0 DESC) AS pick
      FROM q JOIN seg ON seg.kind = q.k % 3 WHERE share * q.target <= start)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN round(least(t0 + CASE WHEN start <= before_ THEN 0.0
            ELSE 2 * (start - before_) / (r + sqrt(greatest(r * r + 2 * sl * (start - before_), 0.0))) END, 1.0), 9) END AS position
FROM z WHERE pick = 1
"""
