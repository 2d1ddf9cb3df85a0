"""Pipeline stages against brute force, on documents and on rows with nulls, repeats and clashing columns."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from cohort.llm import language_id, mixing, quality_rules
from cohort.llm.queries import vocabulary
from pyspark.sql import functions as F

from test_operators import brute_components

CLASH = ["id", "row", "body", "kept_id", "sha", "own", "n", "position", "positions", "mix_id", "h", "l_", "tie", "key", "size"]


@pytest.fixture(scope="module")
def odd(edge):
    """Repeated rows, an id with two texts, nulls, and a column for every name that a stage uses."""
    rows = edge.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    more = rows.where("doc_id in (5, 7)").withColumn("text", F.concat(F.lit("another text "), F.substring("text", 1, 40)))
    copies = rows.where("doc_id = 5").withColumn("doc_id", F.lit(50).cast("long"))
    return rows.unionByName(more).unionByName(copies).unionByName(copies).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).repartition(3)


def bag(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_exact_stage(spark, small, request, name):
    docs = request.getfixturevalue(name)
    rows = bag(docs)
    top = {}
    for i, t in rows:
        k = t or ""
        top[k] = max([x for x in (top.get(k), i) if x is not None], default=None)
    got = bag(corpus_pipeline.exact_stage(spark, docs, small))
    assert Counter({k: n for (_, t), n in got.items() for k in [t or ""]}) == Counter(dict.fromkeys(top, 1))
    assert all(top[t or ""] == i and (i, t) in rows for i, t in got)


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_near_stage(spark, small, request, name):
    docs = request.getfixturevalue(name)
    kept = bag(corpus_pipeline.near_stage(spark, docs, small))
    if name == "documents":
        found = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert set(kept) == {(i, t) for i, t in bag(docs) if found[i][1] == i}
    else:
        assert {i for i, _ in kept} >= {1, 2, 3, 4, 5, 7, None} and 50 not in {i for i, _ in kept} and 6 not in {i for i, _ in kept}


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_quality_and_mixing_stages(spark, small, request, name):
    docs = request.getfixturevalue(name)
    good = {(r["doc_id"]) for r in quality_rules.quality_rows(docs).where("kept").collect()}
    got = corpus_pipeline.quality_stage(spark, docs, small)
    assert got.columns == docs.columns and {i for i, _ in bag(got)} == good
    times = Counter()
    for r in mixing.mix(docs).where("taken > 0").collect():
        times[r["doc_id"], r["tie"]] = max(times[r["doc_id"], r["tie"]], len(r["positions"]))
    mixed = corpus_pipeline.mixing_stage(spark, docs, small)
    have = Counter((r["doc_id"], r["tie"]) for r in mixed.select("doc_id", F.xxhash64("text").alias("tie")).collect())
    stands = Counter((r["doc_id"], r["tie"]) for r in docs.select("doc_id", F.xxhash64("text").alias("tie")).collect())
    assert mixed.columns == docs.columns and have == Counter({k: n * stands[k] for k, n in times.items()})


def test_token_stage(spark, small, odd):
    import base64

    import tiktoken
    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = bag(odd)
    for r in corpus_pipeline.token_stage(spark, odd, small).collect():
        ids = {len(own.encode_ordinary(t or "")) for i, t in texts if i == r["doc_id"]}
        digests = {hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts if i == r["doc_id"]}
        assert r["n_tokens"] in ids and r["decoded_sha256"] in digests


def test_empty_table_and_whole_run(spark, small, odd):
    none = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0
    got = corpus_pipeline.run(spark, small)
    assert got.count() > 100 and got.columns[:2] == ["doc_id", "n_tokens"]


def test_language_of_rows_with_clashing_columns(spark, odd):
    assert language_id.identify(odd).count() == odd.count()
