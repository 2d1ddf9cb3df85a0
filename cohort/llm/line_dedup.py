"""Line dedup by distinct-site spread, in built-in functions only.

A line that occurs on many sites is boilerplate. For each line a HyperLogLog sketch of the sites is built; partial
sketches are merged by aggregation, so a line that is everywhere costs one sketch per task. Lines whose estimate is
near the threshold get an exact distinct count. Boilerplate lines are then removed from every document.

Lines are compared as trimmed; lines with fewer than ``min_words`` words are never removed.

Cases: a null site counts as one site of its own; null texts have no lines and come back as the empty text; a text
left without lines becomes empty; repeated lines of one document all go; rows that repeat are treated alike as
long as they agree on (key, text); an empty table gives no rows; columns of docs other than key, text and site are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import word_count

#: Sites from which on a line is boilerplate.
SITES = 10
#: log2 of the registers of a sketch: its relative standard error is 1.04 / sqrt(2**LG_K), 3.3 %.
LG_K = 10
#: Estimates within this share of the threshold are counted exactly: more than five standard errors.
NEAR = 0.2
MIN_WORDS = 4


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\v\f\r"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (line_key): 128-bit keys of the lines that occur on ``sites`` sites or more."""
    lines = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\u0000null")).alias("site"), F.explode(lines_of(F.col(text))).alias("line"))
    lines = lines.withColumn("line", trimmed(F.col("line"))).where(word_count(F.col("line")) >= min_words)
    # equal (line, site) pairs meet in the map task first; at most `sites in the corpus` rows per line and task are left
    pairs = lines.select(line_key(F.col("line")).alias("line_key"), "site").distinct()
    spread = pairs.groupBy("line_key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("line_key", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = spread.where(F.col("estimate") >= (1 - NEAR) * sites)
    sure = spread.where(F.col("estimate") > (1 + NEAR) * sites).select("line_key")
    near = spread.where(F.col("estimate") <= (1 + NEAR) * sites).select("line_key")
    exact = pairs.join(near, "line_key", "left_semi").groupBy("line_key").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("line_key")
    return sure.unionByName(exact)


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES,
                       min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (key, n_lines, n_removed, text): the lines of each document without those that are boilerplate."""
    bad = boilerplate(docs, text, site, sites, min_words)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("id", F.xxhash64("key", "text"))
    lines = rows.select("id", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), trimmed))).alias("line"))
    hit = (lines.where(word_count(F.col("line")) >= min_words).select("id", line_key(F.col("line")).alias("line_key"))
           .join(bad, "line_key").groupBy("id").agg(F.collect_set("line_key").alias("bad")))
    kept = F.when(F.col("bad").isNull(), lines_of(F.col("text"))).otherwise(
        F.filter(lines_of(F.col("text")), lambda x: ~F.array_contains(F.col("bad"), line_key(trimmed(x)))))
    out = rows.join(hit, "id", "left").withColumn("kept", kept)
    n = F.array_size(lines_of(F.col("text")))
    return out.select(F.col("key").alias(key), n.cast("long").alias("n_lines"), (n - F.array_size("kept")).cast("long").alias("n_removed"),
                      F.array_join("kept", "\n").alias("text"))


#: The same in SQL: clean lines joined again, by a digest of the cleaned text.
ORACLE = f"""
WITH l AS (SELECT doc_id, coalesce(source, chr(1) || 'null') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, site, line, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM l),
w AS (SELECT *, len(regexp_extract_all(core, '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS} AS long_enough FROM t),
bad AS (SELECT core FROM w WHERE long_enough GROUP BY core HAVING count(DISTINCT site) >= {SITES}),
f AS (SELECT w.*, bad.core IS NOT NULL AS removed FROM w LEFT JOIN bad ON w.core = bad.core)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '')) AS text_sha256
FROM f GROUP BY doc_id
"""
