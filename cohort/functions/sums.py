"""Sums and means of doubles that don't depend on the order of addition.

A double is cut into integer limbs of ``BITS`` bits, at fixed powers of two; scaling by powers of two, rounding
to integers and the difference of two roundings are exact, so that the limbs' integer sums are the same whatever the partitions, retries or the plan. They become a
double once, at the end. Values below 2**TOP in size keep everything down to 2**(TOP - LIMBS * BITS) (about 2e-22);
larger ones, infinities and NaN are added as doubles beside. Integer sums hold 2**39 rows; beyond, Spark raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from cohort.session import ship

TOP = 48
BITS = 24
LIMBS = 5


def exact_sum(x: Column) -> Column:
    """Aggregate: the sum of a double column; null without values. For many columns, see ``long_sums``."""
    x = x.cast("double")
    small = F.abs(x) < F.lit(2.0**TOP)
    total = None
    for i in reversed(range(LIMBS)):  # the least limbs first: less is lost when doubles are added
        low = 2.0 ** (TOP - (i + 1) * BITS)
        upper = F.rint(x * F.lit(2.0**-BITS / low)) * F.lit(2.0**BITS) if i else F.lit(0.0)
        limb = F.sum(F.when(small, (F.rint(x * F.lit(1 / low)) - upper).cast("long"))).cast("double") * F.lit(low)
        total = limb if total is None else total + limb
    beyond = F.sum(F.when(~small, x))
    return F.coalesce(total + beyond, total, beyond)


def exact_avg(x: Column) -> Column:
    """Aggregate: the mean of a double column; null without values."""
    return F.try_divide(exact_sum(x), F.count(x))


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """The limbs of ``exact_sum``, highest first, of values below 2**TOP in size."""
    out = []
    for i in range(LIMBS):
        low = 2.0 ** (TOP - (i + 1) * BITS)
        upper = np.rint(x * (2.0**-BITS / low)) * 2.0**BITS if i else 0.0
        out.append((np.rint(x * (1 / low)) - upper).astype("int64"))
    return out


def long_sums(df: DataFrame, columns: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One row per group: ``by``, ``rows`` and for every named column ``s_<name>`` (sum) and ``n_<name>`` (values).

    The sums are those of ``exact_sum``. Tasks cut a few thousand rows at a time into limbs and give one row per group and column,
    whose integers Spark adds up.
    """
    by = by or []
    spark, k, parts = df.sparkSession, len(by), [f"l{i}" for i in range(LIMBS)]
    ship(spark)
    typed = df.select(*by, *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])
    counts = StructType([*typed.schema.fields[:k], *[StructField(n, IntegerType() if n == "i" else DoubleType() if n == "beyond" else LongType())
                                                     for n in ("i", *parts, "small", "beyond", "more", "rows")]])

    names = counts.names

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = np.ones(len(batch), dtype="int64")
            for i in range(batch.num_columns - k):
                column = batch.column(k + i)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                x = column.fill_null(0.0).to_numpy(zero_copy_only=False)
                small = there & (np.abs(x) < 2.0**TOP)
                limbs = [pa.array(limb) for limb in _limbs(np.where(small, x, 0.0))]
                more = there & ~small
                sums = pa.table([*batch.columns[:k], *limbs, pa.array(small.astype("int64")), pa.array(np.where(more, x, 0.0)), pa.array(more.astype("int64")), pa.array(ones)],
                                names=[*[f"k{j}" for j in range(k)], *parts, "small", "beyond", "more", "rows"])
                found = sums.group_by([f"k{j}" for j in range(k)], use_threads=False).aggregate([(n, "sum") for n in (*parts, "small", "beyond", "more", "rows")])
                got = found.select([*[f"k{j}" for j in range(k)], *[f"{n}_sum" for n in (*parts, "small", "beyond", "more", "rows")]]).combine_chunks()
                arrays = [c.combine_chunks() for c in got.columns]
                if len(got):
                    arrays.insert(k, pa.array(np.full(len(got), i, dtype="int32")))
                    yield pa.RecordBatch.from_arrays(arrays, names)

    sums = typed.mapInArrow(partial, counts).groupBy(*by, "i").agg(*[F.sum(n).alias(n) for n in (*parts, "small", "beyond", "more", "rows")])
    total = None
    for i in reversed(range(LIMBS)):  # the least limbs first, as in exact_sum
        limb = F.col(parts[i]).cast("double") * F.lit(2.0 ** (TOP - (i + 1) * BITS))
        total = limb if total is None else total + limb
    total, beyond = F.when(F.col("small") > 0, total), F.when(F.col("more") > 0, F.col("beyond"))
    sums = sums.select(*by, "i", F.coalesce(total + beyond, total, beyond).alias("s"), (F.col("small") + F.col("more")).alias("n"), "rows")
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = [e for i, name in enumerate(columns) for e in (pick("s", i).alias(f"s_{name}"), F.coalesce(pick("n", i), F.lit(0)).alias(f"n_{name}"))]
    return sums.groupBy(*by).agg(F.max("rows").alias("rows"), *wide)


def long_means(df: DataFrame, columns: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One row per group: ``by``, ``rows`` and the mean of every named column."""
    sums = long_sums(df, columns, by)
    return sums.select(*(by or []), "rows", *[F.try_divide(F.col(f"s_{n}"), F.col(f"n_{n}")).alias(n) for n in columns])
