"""Merkle manifest against a tree built level by level in Python."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from cohort.llm import merkle

FIELDS = merkle.FIELDS
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    parts = []
    for c in FIELDS:
        value = row[c]
        if c == "text" and lower and value is not None:
            value = value.translate(LOW)
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha("".join(parts))


def climb(digests):
    """The digest that remains, and for each leaf its path as (digests before, digests after) per level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[k:k + 16] for k in range(0, len(digests), 16)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // 16][:i % 16], runs[i // 16][i % 16 + 1:]))
        at, digests = [i // 16 for i in at], [sha("".join(r)) for r in runs]
    return digests[0], paths


def brute(rows, lower=lambda row: False):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    below = {s: climb([leaf(r) for r in groups[s]]) for s in order}
    root, above = climb([below[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], below[s][1], strict=True):
            folded, shown = leaf(r, lower(r)), ""
            for before, after in path + above[k]:
                folded, shown = sha("".join([*before, folded, *after])), shown + "".join(before + after)
            out.append((r["doc_id"], leaf(r), below[s][0], root, sha(shown), folded, folded == root))
    return sorted(out, key=str)


def fifth(row):
    return row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0


def rows_of(docs):
    return sorted(map(tuple, merkle.manifest(docs, claimed=merkle.tampered(docs), proofs=False).collect()), key=str)


def test_manifest_equals_brute_force(documents):
    got = rows_of(documents)
    assert got == brute(documents.collect(), fifth) and 0 < sum(not r[-1] for r in got) < len(got) / 2


def test_trees_of_many_sizes_and_ranges(spark):
    """Sources of 1, 2, 16, 17, 256, 257 and 4,200 leaves: up to three sweeps, last runs of one node."""
    sizes = {None: 1, "": 2, "a": 16, "b": 17, "c": 256, "é": 257, "z": 4200}
    rows = [(k * 7, s, None, k, f"Text {s} {k}") for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert rows_of(docs) == brute(docs.collect(), fifth)


def test_more_sources_than_a_range(spark):
    docs = spark.range(600).select("id", F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"), F.lit("en").alias("lang"),
                                   F.lit(3).alias("n_chars"), F.lit("Abc").alias("text"))
    assert rows_of(docs) == brute(docs.collect(), fifth)


def test_proofs_lead_to_the_root(documents):
    rows = merkle.manifest(documents).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] == merkle.fold(r["leaf"], r["proof"]) for r in rows)
    assert all(merkle.fold(rows[0]["leaf"], r["proof"]) != r["root"] for r in rows[1:] if r["leaf"] != rows[0]["leaf"])


def test_edges(edge, empty):
    docs = edge.withColumnsRenamed({"n": "n_chars"}).withColumns({"idx": F.lit(5), "tree": F.lit("x"), "digest": F.lit("y"), "part": F.lit(1)})
    got = rows_of(docs)
    assert len(got) == 10 and got == brute(docs.collect(), fifth) and sum(r[0] == 4 for r in got) == 2
    none = empty.withColumnsRenamed({"n": "n_chars"})
    assert merkle.manifest(none).count() == 0
    one = docs.where("doc_id = 8")
    row = merkle.manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof"] == "" and row["proof_sha256"] == sha("") and row["verified"]
