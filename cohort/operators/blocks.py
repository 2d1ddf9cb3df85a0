"""Vector rows as numpy blocks inside tasks, and the sums that tasks send back.

Spark deals and keeps the rows; a task sees them a few thousand at a time as a matrix and gives one row per group (a model's
cluster), which Spark adds up over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.session import ship

BLOCK_ROWS = 4096
SUMS = "g int, n long, s array<double>"
#: Partitions whose sums may come to the driver one by one, and bytes of packed rows that may.
FEW_PARTS, FEW_BYTES = 32, 8 << 20


def packed(df: DataFrame, x: Column) -> DataFrame:
    """Rows (d, x): up to ``BLOCK_ROWS`` vectors of doubles each, as the bytes of a matrix."""
    ship(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch)
            parts = [m[i:i + BLOCK_ROWS] for i in range(0, len(m), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array([p.shape[1] for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["d", "x"])

    return df.select(x.alias("x")).mapInArrow(pack, "d int, x binary")


@dataclass
class Blocks:
    """Packed rows that many passes read."""

    rows: DataFrame  # persisted
    counts: list[int]  # vectors of each partition
    here: list[tuple[int, np.ndarray]] | None  # (partition, matrix) in order, where there are ``FEW_BYTES`` at most

    def unpersist(self) -> None:
        self.rows.unpersist()


def kept(rows: DataFrame) -> Blocks:
    """Packed rows, persisted; a pass over few bytes is all start-up time of tasks, so that the driver gets these."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["p"]: r for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.expr("length(x) div (8 * d)")).alias("n"), F.sum(F.length("x")).alias("b")).collect()}
    counts = [int(sizes[p]["n"]) if p in sizes else 0 for p in range(max(sizes, default=-1) + 1)]
    here = None
    if sum(r["b"] for r in sizes.values()) <= FEW_BYTES:
        here = [(r["p"], np.frombuffer(r["x"], dtype="float64").reshape(-1, r["d"])) for r in rows.select(F.spark_partition_id().alias("p"), "d", "x").collect()]
    return Blocks(rows, counts, here)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The first column, arrays of doubles of one length without nulls, as a matrix."""
    column = batch.column(0)
    if column.null_count or column.flatten().null_count:
        raise ValueError("a vector or a coordinate is null")
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The matrices of a batch of arrays or of packed rows."""
    if batch.schema.names == ["d", "x"]:
        for d, x in zip(batch.column("d").to_pylist(), batch.column("x"), strict=True):
            yield np.frombuffer(x.as_buffer(), dtype="float64").reshape(-1, d)
    elif len(batch):
        yield matrix(batch)


def block_sums(rows: DataFrame | Blocks, groups: int, width: int, measure: Callable[[np.ndarray], Iterator[tuple[int, int, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (groups) and sums (groups x width) of what ``measure`` gives for each block: (group, rows, sums), or many groups and arrays of both."""
    n, s = np.zeros(groups, dtype="int64"), np.zeros((groups, width))

    def add(n: np.ndarray, s: np.ndarray, x: np.ndarray) -> None:
        for g, count, sums in measure(x):
            n[g] += count
            s[g] += sums

    if isinstance(rows, Blocks) and rows.here is not None:
        for _, x in rows.here:
            add(n, s, x)
        return n, s
    few = isinstance(rows, Blocks) and len(rows.counts) <= FEW_PARTS  # the driver adds up their sums: a job of one stage
    rows = rows.rows if isinstance(rows, Blocks) else rows
    ship(rows.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(groups, dtype="int64"), np.zeros((groups, width))
        for batch in batches:
            for x in matrices(batch):
                add(n, s, x)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(list(s[used]), pa.list_(pa.float64()))], ["g", "n", "s"])

    found = rows.mapInArrow(partial, SUMS)
    if not few:
        total = vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("s")).getField("sum"))
        found = found.groupBy("g").agg(F.sum("n").alias("n"), total.alias("s"))
    for r in found.collect():  # one row a group, of each partition if they are few
        n[r["g"]] += r["n"]
        s[r["g"]] += r["s"]
    return n, s


def stacked(sets: list[np.ndarray]) -> np.ndarray:
    """Sets of points as one array (sets x points x coordinates); short sets are filled up with points that nothing is near to."""
    out = np.full((len(sets), max(map(len, sets)), sets[0].shape[1]), np.inf)
    for i, c in enumerate(sets):
        out[i, :len(c)] = c
    return out


def scored(x: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Squared distances less the rows' squared norms (sets x points x rows), by one product; ``sets`` as of ``stacked``."""
    there = np.isfinite(sets[..., :1])
    c = np.where(there, sets, 0.0)
    norm = np.where(there[..., 0], (c * c).sum(axis=2), np.inf)
    out = (-2.0 * c.reshape(-1, c.shape[2]) @ x.T).reshape(*norm.shape, len(x))
    out += norm[..., None]
    return out


def pieces(x: np.ndarray, points: int) -> Iterator[slice]:
    """Slices of rows, so many that a table of them by ``points`` stays in the processor's cache."""
    step = max(128, (1 << 17) // points)
    for i in range(0, len(x), step):
        yield slice(i, i + step)


def nearest_of(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and value of the least entry of each column, the first on ties."""
    near, best = np.zeros(d2.shape[1], dtype="int32"), d2[0].copy()
    for j in range(1, len(d2)):
        less = d2[j] < best
        near[less] = j
        np.minimum(best, d2[j], out=best)
    return near, best


def square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (centres x rows), differences summed in the order of the coordinates."""
    out = np.zeros((len(centres), len(x)))
    for j in range(x.shape[1]):
        column = np.ascontiguousarray(x[:, j])
        for i, c in enumerate(centres[:, j]):
            off = column - c
            out[i] += off * off
    return out
