"""Exact quantiles by distributed selection of ranks.

No value list of a group ever meets in one buffer or task. Where a group and feature have at most ``small`` distinct
values (by HyperLogLog), the rows are counted by value (combined in the map tasks), and running sums over these counts
give the ranks' values. Else every wanted rank has a range of values that holds it, at first from the smallest to the
largest. While a range holds more values, its rows are counted in cells between split points (``percentile_approx``, whose
buffer is bounded), and the range shrinks to the cells that hold the wanted ranks; the split points only steer, the
counts are exact. Then the range's rows are counted by value. Each round is one pass over the rows inside the ranges;
what it returns is a few rows per group and feature.

Null values don't count; NaN is the largest value; a feature without values has null quantiles; an empty table has no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.session import shared_table

#: Distinct values that one range may hold when its values are counted one by one.
SMALL = 50_000
#: Cells into which a round divides a range.
CELLS = 64


def _long(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """(by..., feature, value) without nulls."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.feature", "p.value").where(F.col("value").isNotNull())


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys: a null group is a group."""
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out


def _inside(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``values`` inside a wanted range, once per range."""
    found = values.join(wanted, _same(values, wanted, keys)).where((values["value"] >= wanted["lo"]) & (values["value"] <= wanted["hi"]))
    return found.select(*[wanted[c] for c in wanted.columns], values["value"])


def _narrow(values: DataFrame, wanted: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """One round: each wanted range shrinks to the cells that hold its two ranks."""
    per = [*keys, "p"]
    rows = _inside(values, wanted, keys)
    steps = F.percentile_approx("value", [i / cells for i in range(1, cells)], 100 * cells)
    splits = shared_table(rows.groupBy(*per).agg(F.array_distinct(steps).alias("splits")), "quantile-splits")
    have = wanted.join(splits, [wanted[k].eqNullSafe(splits[k]) for k in per]).select(*[wanted[c] for c in wanted.columns], splits["splits"])
    # cells are open below and closed above a split point; a value that repeats may fill one alone
    placed = _inside(values, have, keys).withColumn("cell", F.size(F.filter("splits", lambda s: s < F.col("value"))))
    counts = placed.groupBy(*per, "n", "at", "below", "cell").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("value").alias("values"),
                                                                   F.min("value").alias("least"), F.max("value").alias("most"))
    before = F.sum("rows").over(Window.partitionBy(*per).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cum = counts.withColumn("before", F.col("below") + F.coalesce(before, F.lit(0)))
    rank, following = F.floor("at"), F.least(F.floor("at") + 1, F.col("n") - 1)
    held = cum.where((F.col("before") <= following) & (F.col("before") + F.col("rows") > rank))
    return shared_table(held.groupBy(*per, "n", "at").agg(F.min("before").alias("below"), F.sum("values").alias("values"),
                                                          F.min("least").alias("lo"), F.max("most").alias("hi")), "quantile-ranges")


def value_stats(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., feature, n, values, lo, hi, mean, std, nulls) in one pass, written to the shared folder; ``values``: about how many distinct."""
    aggs, entries, by = [], [], by or []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        found = {"n": F.count(x), "values": F.approx_count_distinct(x, 0.1), "lo": F.min(x), "hi": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x), "nulls": F.count_if(x.isNull())}
        aggs += [c.alias(f"{name}__{i}") for name, c in found.items()]
        entries.append(F.struct(F.lit(f).alias("feature"), *[F.col(f"{name}__{i}").alias(name) for name in found]))
    wide = df.groupBy(*by).agg(*aggs)
    return shared_table(wide.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*"), "value-stats")


def _pick(cum: DataFrame, groups: list[str], at: Column, n: Column) -> DataFrame:
    """Values at the ranks around ``at`` from running counts ``upto`` by value, interpolated."""
    rank, following = F.floor(at), F.least(F.floor(at) + 1, n - 1)
    found = cum.groupBy(*groups).agg(F.min(F.when(F.col("upto") > rank, F.col("value"))).alias("a"), F.min(F.when(F.col("upto") > following, F.col("value"))).alias("b"))
    frac = at - F.floor(at)
    # equal neighbours need no interpolation, which infinite values wouldn't stand
    value = F.when((F.col("a") == F.col("b")) | (frac == 0), F.col("a")).otherwise(F.col("a") * (1 - frac) + F.col("b") * frac)
    return found.withColumn("value", value)


def _by_value(values: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of groups with few distinct values: rows counted by value, running sums over these counts."""
    counted = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("rows"))
    cum = counted.select("*", F.sum("rows").over(Window.partitionBy(*keys).orderBy("value")).alias("upto"), F.sum("rows").over(Window.partitionBy(*keys)).alias("n"))
    cum = cum.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    return _pick(cum, [*keys, "p", "n"], F.col("p") * (F.col("n") - 1), F.col("n")).select(*keys, "p", "n", "value")


def exact_quantiles(df: DataFrame, features: list[str], probs: list[float], by: list[str] | None = None, small: int = SMALL,
                    cells: int = CELLS, stats: DataFrame | None = None) -> DataFrame:
    """(by..., feature, p, n, value): linearly interpolated quantiles at position ``p * (n - 1)``, one row per group, feature and p.

    ``stats``: what ``value_stats`` has found, if it is known already.
    """
    keys = [*(by or []), "feature"]
    values = _long(df, features, by or [])
    stats = (value_stats(df, features, by) if stats is None else stats).where("n > 0")
    narrow = (F.col("values") <= small) | (F.col("lo") == F.col("hi"))
    if stats.where(~narrow).isEmpty():
        return _by_value(values, keys, probs)
    few = stats.where(narrow)
    out = _by_value(values.join(few, _same(values, few, keys), "left_semi"), keys, probs)
    open_ = stats.where(~narrow).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).select(
        *keys, "p", "n", (F.col("p") * (F.col("n") - 1)).alias("at"), F.lit(0).cast("long").alias("below"), "values", "lo", "hi")
    while not open_.isEmpty():
        ranges = _narrow(values, open_, keys, cells)
        open_, done = ranges.where(~narrow), ranges.where(narrow)
        # a range of one value is that value; the others are counted by value
        counted = _inside(values, done.where("lo < hi"), keys).groupBy(*keys, "p", "n", "at", "below", "value").agg(F.count(F.lit(1)).alias("rows"))
        cum = counted.withColumn("upto", F.col("below") + F.sum("rows").over(Window.partitionBy(*keys, "p").orderBy("value")))
        out = out.unionByName(done.where("lo = hi").select(*keys, "p", "n", F.col("lo").alias("value")))
        out = out.unionByName(_pick(cum, [*keys, "p", "n", "at"], F.col("at"), F.col("n")).select(*keys, "p", "n", "value"))
    return out


def quantile_columns(df: DataFrame, features: list[str], probs: dict[str, float], by: list[str] | None = None, **how) -> DataFrame:
    """(by..., feature, <one column per name in probs>)."""
    keys = [*(by or []), "feature"]
    found = exact_quantiles(df, features, list(probs.values()), by, **how)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in probs.items()])
