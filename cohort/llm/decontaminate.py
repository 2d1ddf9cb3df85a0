"""Benchmark decontamination by a positional inverted index, in built-in functions only.

1. ``build_index`` stores one posting (term, row, pos) for every word of every document in the shared folder. Each task
   sorts the postings of its documents by term, so that a file is the inverted index of its share of the documents: lists
   are runs of rows, statistics of the file let a reader skip terms, and no list, however long, meets in one task.
2. Every window of ten words of a benchmark item is looked up from its rarest term: the lists of its ``PROBES`` rarest
   terms, by their number of postings, are intersected one after another, each posting shifted by its term's offset.
   What is left is (document, item, position at which the item would begin), some of it by chance.
3. ``phrases`` compares these alignments word by word with the document: exact matches. ``near`` returns the documents in
   which the rarest terms of a window stand within ``span`` words of each other, in any order: proximity matches.

Terms and rows are 64-bit hashes in the index: equal hashes only add alignments, which the comparison drops again.
Small tables (vocabulary, windows) are joined by Spark's own choice: broadcast below the session's threshold, else shuffled.

Words: A-Z in lower case, then runs of ASCII digits, letters and of all other characters from U+0080 on.

Cases: null, empty and wordless texts have no words, hits or windows; an item with fewer than ten words is one window;
items with equal words are searched once; a null item_id counts as the empty string; item_ids that repeat count once;
null or repeated doc_ids are fine, every row is searched by itself and equal rows alike; empty tables give no
rows (documents) or no hits (benchmark); other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.llm.common import let, materialise

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, in lower case and before lower-casing: splitting costs a seventh of extracting each match.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window.
WINDOW = 10
#: Lists that are intersected for a window, the rarest first.
PROBES = 3
#: Words from its rarest term within which a proximity match has a window's other rare terms.
SPAN = 20


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def between(text: Column, gap: str) -> Column:
    """What ``gap`` (runs of characters) leaves of a text; a gap at either end leaves nothing there."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def terms(text: Column) -> Column:
    return between(lowered(text), GAP)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (row, key, text): equal rows have the same ``row``."""
    return docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term, row, pos) of all words, sorted by term within each file of the shared folder."""
    words = keyed(docs, key, text).select("row", F.posexplode(terms(F.col("text"))).alias("pos", "word"))
    return materialise(words.select(F.xxhash64("word").alias("term"), "row", "pos").sortWithinPartitions("term", "row", "pos"), "postings")


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item, words, ids): the different word sequences of a benchmark, with the ids of the items that have them."""
    rows = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), terms(F.col(text)).alias("words")).where(F.size("words") > 0)
    same = rows.groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return materialise(same.select(F.monotonically_increasing_id().alias("item"), "words", "ids"), "benchmark-items")


def rarest(index: DataFrame, items: DataFrame, probes: int = PROBES) -> DataFrame:
    """Rows (item, offsets, found): for every window the offsets in the item and terms of its rarest terms, the rarest first.

    Windows of an item that share these are one row.
    """
    words = items.select("item", F.posexplode("words").alias("pos", "word")).select("item", "pos", F.xxhash64("word").alias("term"))
    vocabulary = materialise(words.select("term").distinct(), "benchmark-terms")
    df = materialise(index.select("term").join(vocabulary, "term", "left_semi").groupBy("term").count(), "benchmark-frequencies")
    counted = words.join(df, "term", "left").select("item", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "pos", "term").alias("w"))
    lists = counted.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("w.pos").alias("pos"), F.col("w.n").alias("n"), F.col("w.term").alias("term")))).alias("w"))
    begins = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    by_count = lambda i: F.array_sort(F.transform(F.slice("w", i, F.lit(WINDOW)), lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos"), x["term"].alias("term"))))
    windows = lists.select("item", F.explode(F.transform(begins, lambda i: F.slice(by_count(i), 1, probes))).alias("r"))
    # a window with a term that no document has needs no list
    return materialise(windows.where(F.col("r")[0]["n"] > 0).select("item", F.transform("r", lambda x: x["pos"]).alias("offsets"), F.transform("r", lambda x: x["term"]).alias("found")).distinct(), "benchmark-windows")


def postings_of(index: DataFrame, windows: DataFrame) -> DataFrame:
    """The lists of the windows' rarest terms, read once."""
    needed = materialise(windows.select(F.explode("found").alias("term")).distinct(), "wanted-terms")
    return materialise(index.join(needed, "term", "left_semi"), "wanted-postings")


def alignments(index: DataFrame, items: DataFrame, probes: int = PROBES) -> DataFrame:
    """Rows (row, item, start): where an item would begin (below 0: before the text) if one of its windows occurs in a document."""
    windows = rarest(index, items, probes)
    lists = postings_of(index, windows)
    found = lists.join(windows.withColumn("term", F.col("found")[0]), "term").select("row", "item", (F.col("pos") - F.col("offsets")[0]).alias("start"), "offsets", "found").distinct()
    for k in range(1, probes):
        have = found.where(F.size("offsets") > k)
        met = have.withColumns({"term": F.col("found")[k], "pos": F.col("start") + F.col("offsets")[k]}).join(lists, ["row", "term", "pos"], "left_semi")
        found = materialise(met.select(*found.columns).unionByName(found.where(F.size("offsets") <= k)), "alignments")
    return found.select("row", "item", "start").distinct()


def phrases(docs: DataFrame, items: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text", probes: int = PROBES) -> DataFrame:
    """Rows (key, n_words, hits, items), one per row of docs: positions of words in an occurrence of a window, ids of the items."""
    found = alignments(index, items, probes).groupBy("row", "item").agg(F.collect_list("start").alias("starts"))
    tried = found.join(items, "item").groupBy("row").agg(F.collect_list(F.struct("starts", "words", "ids")).alias("tried"))
    rows = keyed(docs, key, text).join(tried, "row", "left")

    def begins(w: Column, x: Column, size: Column) -> Column:
        """Positions (from 0) in the document at which windows of the item begin."""
        spots = lambda s: F.transform(F.filter(F.sequence(F.greatest(F.lit(0), -s), F.least(F.size(x["words"]), F.size(w) - s) - size),
                                               lambda i: F.slice(w, s + i + 1, size) == F.slice(x["words"], i + 1, size)), lambda i: s + i)
        fits = F.filter(x["starts"], lambda s: F.least(F.size(x["words"]), F.size(w) - s) - size >= F.greatest(F.lit(0), -s))
        return F.flatten(F.transform(fits, spots))

    def matched(w: Column) -> Column:
        def one(x: Column) -> Column:
            size = F.least(F.size(x["words"]), F.lit(WINDOW))
            at = begins(w, x, size)
            hit = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + size - 1))))
            return F.struct(hit.alias("hits"), x["ids"].alias("ids"))
        return F.filter(F.transform("tried", one), lambda m: F.size(m["hits"]) > 0)

    met = rows.withColumn("m", F.when(F.col("tried").isNotNull(), let(terms(F.col("text")), matched)).otherwise(F.array().cast("array<struct<hits:array<int>,ids:array<string>>>")))
    n_words = F.size(between(F.col("text"), GAP_ANY_CASE)).cast("long")
    return met.select(F.col("key").alias(key), n_words.alias("n_words"), F.array_sort(F.array_distinct(F.flatten("m.hits"))).alias("hits"),
                      F.array_sort(F.array_distinct(F.flatten("m.ids"))).alias("items"))


def near(index: DataFrame, items: DataFrame, span: int = SPAN, probes: int = PROBES) -> DataFrame:
    """Rows (row, item, first, last): proximity matches, a window's ``probes`` rarest terms less than ``span`` words from its rarest one.

    A match takes the posting of each further term that is nearest to the rarest one's, the one before at equal
    distance; ``first`` and ``last`` are the ends of what it takes. Equal terms of a window count once.
    """
    windows = rarest(index, items, probes).select("item", F.array_distinct("found").alias("found")).distinct()
    lists = postings_of(index, windows)
    found = lists.join(windows.withColumn("term", F.col("found")[0]), "term").select("row", "item", "found", F.col("pos").alias("at"), F.col("pos").alias("first"), F.col("pos").alias("last"))
    for k in range(1, probes):
        have = found.where(F.size("found") > k).withColumn("term", F.col("found")[k])
        # postings meet those of their own and the neighbouring blocks of span words
        blocks = have.withColumn("block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at") / span) + d)))
        other = lists.select("row", "term", F.col("pos").alias("pos_"), F.floor(F.col("pos") / span).alias("block"))
        close = blocks.join(other, ["row", "term", "block"]).where(F.abs(F.col("pos_") - F.col("at")) < span)
        best = close.groupBy(*found.columns).agg(F.min(F.struct(F.abs(F.col("pos_") - F.col("at")).alias("d"), F.col("pos_").alias("p"))).alias("b"))
        met = best.withColumns({"first": F.least("first", "b.p"), "last": F.greatest("last", "b.p")})
        found = materialise(met.select(*found.columns).unionByName(found.where(F.size("found") <= k)), "proximity")
    return found.select("row", "item", "first", "last").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (key, n_words, hits, items) of exact matches, one per row of docs; ``hits`` are word positions from 0."""
    return phrases(docs, items_of(benchmark, item_key, item_text), build_index(docs, key, text), key, text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_words", F.array_size("hits").cast("long").alias("n_hit"), F.array_size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.array_size("hits") > 0).alias("contaminated"))


#: Every window of every length that the benchmark has, compared as text.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS k
       FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
m AS (SELECT row, i, dw.size, id FROM dw JOIN bw ON dw.size = bw.size AND dw.k = bw.k),
h AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM m) GROUP BY row),
ids AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed FROM (SELECT DISTINCT row, id FROM m) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN ids USING (row)
"""
