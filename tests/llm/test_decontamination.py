"""Decontamination against a search of every window in Python."""

import hashlib
import re

from pyspark.sql import functions as F

from cohort.llm import decontaminate as D

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(D.UPPER, D.LOWER)


def words(text):
    return TERM.findall((text or "").translate(LOW))


def brute(text, items):
    """Positions hit and ids of the items found in one text."""
    w, hits, ids = words(text), set(), set()
    for item, item_text in items:
        x = words(item_text)
        size = min(10, len(x))
        wanted = {tuple(x[i:i + size]) for i in range(len(x) - size + 1)} if x else set()
        at = [i for i in range(len(w) - size + 1) if tuple(w[i:i + size]) in wanted] if x else []
        if at:
            ids.add("" if item is None else str(item))
            hits |= {p for i in at for p in range(i, i + size)}
    return len(w), sorted(hits), sorted(ids)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def check(docs, benchmark):
    items = pairs(benchmark, "item_id")
    got = sorted(((r["doc_id"], r["n_words"], r["hits"], r["items"]) for r in D.decontaminate(docs, benchmark).collect()), key=str)
    want = sorted(((k, *brute(t, items)) for k, t in pairs(docs, "doc_id")), key=str)
    assert got == want
    return got


def test_documents_equal_brute_force(spark, small, documents):
    got = check(documents, spark.read.parquet(f"{small}/benchmark.parquet"))
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_short_repeated_and_odd_items(spark):
    a = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [("a", a), ("copy", a.upper()), ("a", "other words of the same id, no more than nine"), ("one", "Solitaire"), ("two", "red RED"), ("none", " .,; "), ("empty", ""),
             ("null", None), (None, "an item without an id of its own has ten words"), ("é", "Été ÇA über straße \U0001F600 你好 naïve coöperate façade rôle"), ("rep", "go " * 25)]
    benchmark = spark.createDataFrame([(*x, "c", 1) for x in items], "item_id string, text string, row string, item int")
    cut = " ".join(a.split()[1:11])
    docs = [(1, a), (2, cut), (3, " ".join(a.split()[2:11])), (4, f"x {a} y {a}."), (5, "alpha-beta/gamma DELTA\nepsilon zeta eta theta iota; kappa"), (6, "one solitaire and red red red"),
            (7, "go " * 12), (8, "go " * 9), (9, "été ça über straße \U0001F600 你好 naïve coöperate façade rôle!"), (9, "Été ÇA über straße \U0001F600 你好 naïve coöperate façade rôle"), (10, None),
            (None, "x other words of the same ID no more than nine"), (11, "an item without an id of its own has ten words"), (12, ""), (12, ""), (13, "kappa " + a + " go" * 30)]
    check(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, term long, row string"), benchmark)


def test_words_of_odd_texts_without_a_match_each(spark):
    """Gaps at both ends, gaps only, nothing, bytes 0 to 127 and characters beyond; no regular expression extracts or counts words."""
    odd = ["", None, " ", ".,;", " a", "a ", "\n a  b\t", "".join(map(chr, range(128))), "".join(map(chr, range(127, -1, -1))), "x\u0080y\u00a0z \u2003 é\U0001F600-\U0001F600",
           "0/9:A@Z[a`z{", "ÀÉ İK ß", "\x00", "a\x00b\x7fc", "_a__b_", "\u0085\u2028"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = docs.select("doc_id", D.terms(F.col("text")).alias("w"), F.size(D.between(F.col("text"), D.GAP_ANY_CASE)).alias("n")).collect()
    assert {r["doc_id"]: (r["w"], r["n"]) for r in got} == {i: (words(t), len(words(t))) for i, t in enumerate(odd)}
    benchmark = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    check(docs, benchmark)
    plan = D.decontaminate(docs, benchmark)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_" not in plan and "split(" in plan


def test_many_random_texts(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i) % 2)), " ").alias("text"))
    benchmark = rows.where("doc_id % 23 = 0").select(F.col("doc_id").cast("string").alias("item_id"), F.substring("text", 1, 60).alias("text"))
    assert sum(bool(r[2]) for r in check(rows, benchmark)) > 18


def test_index_has_every_word_and_sorted_lists(spark, documents):
    index = D.build_index(documents)
    assert index.count() == sum(len(words(r["text"])) for r in documents.collect())
    parts = index.select(F.spark_partition_id().alias("p"), "term", "row", "pos")
    files = index.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "term").collect()
    by_file = {}
    for r in sorted(files, key=lambda r: r["i"]):
        by_file.setdefault(r["f"], []).append(r["term"])
    assert parts.count() and all(x == sorted(x) for x in by_file.values())


def test_proximity(spark):
    item = "the rareone of the raretwo and the rarethree in the end"
    texts = [(1, "rarethree x y raretwo the the rareone"), (2, "rareone " + "the " * 30 + "raretwo rarethree"), (3, "raretwo rarethree the of and in"), (4, item), (5, "the of and in end " * 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = D.items_of(spark.createDataFrame([("a", item)], "item_id string, text string"))
    found = D.near(D.build_index(docs), items)
    rows = D.keyed(docs, "doc_id", "text").join(found, "row").select("key", "first", "last")
    got = {tuple(r) for r in rows.collect()}
    assert {k for k, _, _ in got} == {1, 4} and (1, 0, 6) in got
    assert {r["doc_id"] for r in D.phrases(docs, items, D.build_index(docs)).where("size(hits) > 0").collect()} == {4}


def test_edges(edge, empty, spark, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    got = check(edge, benchmark)
    assert len(got) == 10 and all(not r[2] for r in got)
    assert D.decontaminate(empty, benchmark).count() == 0
    rows = D.digest(D.decontaminate(edge, benchmark.where("false"))).collect()
    assert len(rows) == 10 and all(not r["contaminated"] and r["items_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
