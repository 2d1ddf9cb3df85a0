"""Exact dedup by an extendible-hash index on shared files.

1. Every text gets a 64-bit key. Distinct keys are counted by their leading bits; the directory doubles (one more
   leading bit) until no bucket holds more keys than its capacity, overfull buckets alone being split.
2. Each map task first joins its own equal texts (a batch is grouped by key and text), so that a group of copies
   reaches its owner as at most one row per batch. Owner tasks take the buckets, sort by key, chain the different
   texts of a key, compare their bytes, and write the entries of the index to the shared folder.
3. Every row looks its entry up by key and SHA-256.

Cases: null counts as the empty text (so null and empty texts are one group); texts are compared without any
change; ``doc_id`` null sorts below every other, a group whose ids are all null keeps the id null; rows that
repeat an id and a text are all kept or dropped as one id; an empty table gives no rows; other columns of the
input are ignored. Groups of any size are met: a hot group never lies in one task as rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import map_arrow, materialise

#: Distinct keys that a bucket holds before it splits.
CAPACITY = 8192
#: Buckets grow beyond the capacity rather than the directory beyond 2**MOST_BUCKETS buckets.
MOST_BUCKETS = 18
#: Leading bits by which one round of counting refines overfull buckets.
STEP = 4
ENTRY = "bucket int, key long, chain int, text_sha256 string, keep_id long, group_size long"


def leading(key, depth: int):
    """The first ``depth`` bits of a 64-bit key, as a number from 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Buckets as (local depth, leading bits) of an extendible hash over distinct ``key`` values.

    Counts come from Spark, by leading bits, for overfull buckets only; their number is at most that of
    buckets times 2**STEP, so the directory is as large as keys / capacity and no larger.
    """
    done, open_, depth = [], [0], 0
    while open_:
        finer = min(64, depth + STEP)
        rows = keys.where(leading(F.col("key"), depth).isin(open_)) if depth else keys
        counted = rows.groupBy(leading(F.col("key"), finer).alias("p")).count().collect()
        size = {r["p"]: r["count"] for r in counted}
        todo, open_ = [(depth, p) for p in open_], []
        while todo:
            d, p = todo.pop()
            width = finer - d
            held = sum(size.get(c, 0) for c in range(p << width, (p + 1) << width))
            if held <= capacity or d == 64:
                done.append((d, p))
            elif d == finer:
                open_.append(p)
            else:
                todo += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        depth = finer
    return sorted(done, key=lambda x: x[1] << (64 - x[0]))


def bucket_of(buckets: list[tuple[int, int]]):
    """Directory as a lookup: doubled to its deepest bucket, with every leading-bits value pointing to a bucket."""
    deepest = max((d for d, _ in buckets), default=0)
    return deepest, [(p << (deepest - d), (p + 1) << (deepest - d), k) for k, (d, p) in enumerate(buckets)]


def _combine(batches):
    """Equal texts of a batch become one row: largest id, number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            got = pa.Table.from_batches([part]).group_by(["bucket", "key", "text"]).aggregate([("doc_id", "max"), ("doc_id", "count"), ("one", "sum")])
            yield from got.select(["bucket", "key", "text", "doc_id_max", "one_sum"]).rename_columns(["bucket", "key", "text", "keep_id", "n"]).to_batches()


def _own(batches):
    """Rows come sorted by bucket and key: chain the texts of a key, comparing bytes; only one key's chain is in memory."""
    import hashlib

    now, chain = None, {}

    def entries():
        rows = [(*now, k, hashlib.sha256(text).hexdigest(), keep, n) for k, (text, (keep, n)) in enumerate(chain.items())]
        names = ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names

    out: list = []

    def flush():
        joined = [pa.concat_arrays([x[0][c] for x in out]) for c in range(6)]
        batch = pa.RecordBatch.from_arrays(joined, names=out[0][1])
        out.clear()
        return batch

    for batch in batches:
        buckets, keys, keeps, ns = (batch.column(k).to_pylist() for k in ("bucket", "key", "keep_id", "n"))
        texts = batch.column("text").cast(pa.binary())
        for i, at in enumerate(zip(buckets, keys, strict=True)):
            if at != now:
                if chain:
                    out.append(entries())
                now, chain = at, {}
            text = texts[i].as_py()
            keep, n = chain.get(text, (None, 0))  # a dict compares the bytes of texts whose hashes agree
            known = [x for x in (keep, keeps[i]) if x is not None]
            chain[text] = (max(known) if known else None, n + ns[i])
        if len(out) >= 1000:
            yield flush()
    if chain:
        out.append(entries())
    if out:
        yield flush()


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Entries (bucket, key, chain, text_sha256, keep_id, group_size), one per different text, written to the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    keys = materialise(texts.select("key").distinct(), "hash-keys")
    buckets = directory(keys, max(capacity, keys.count() >> MOST_BUCKETS))
    deepest, spans = bucket_of(buckets)
    cells = docs.sparkSession.createDataFrame([(cell, k) for a, b, k in spans for cell in range(a, b)], "cell long, bucket int")
    if deepest <= MOST_BUCKETS + 4:  # at most 16 bytes times 2**22; uniform keys stay far below
        cells = F.broadcast(cells)
    placed = texts.join(cells, leading(F.col("key"), deepest) == F.col("cell"))
    rows = map_arrow(placed.select("bucket", "key", "text", "doc_id", F.lit(1).cast("long").alias("one")), _combine, "bucket int, key long, text string, keep_id long, n long")
    owned = rows.repartitionById(max(1, len(buckets)), F.col("bucket")).sortWithinPartitions("bucket", "key")
    return materialise(map_arrow(owned, _own, ENTRY), "hash-index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per row of docs; the largest id of equal texts stays."""
    index = build_index(docs, capacity).select("key", "text_sha256", "keep_id", "group_size")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256"))
    joined = rows.join(index, ["key", "text_sha256"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
