"""Summaries of scored rows: distributions, confidence, first-n views.

Each distribution is a ``groupBy(label)`` with map-side partial aggregation
(a handful of labels), so a label holding most rows costs nothing extra;
shares are computed on the few-row result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort.functions.sums import exact_avg


def distribution(scored: DataFrame, col: str, kind: str | None = None) -> DataFrame:
    """(label, count, percentage) of ``col``; ``kind`` adds a constant column."""
    counts = scored.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    out = counts.select("label", "count", (F.col("count") * F.lit(100.0) / total).alias("percentage"))
    return out.select(F.lit(kind).alias("kind"), "*") if kind else out


def label_distribution(scored: DataFrame) -> DataFrame:
    return distribution(scored, "classification")


def risk_distribution(scored: DataFrame) -> DataFrame:
    return distribution(scored, "risk_level")


def confidence_summary(scored: DataFrame) -> DataFrame:
    """(total, average_confidence); average 0 when there are no rows."""
    return scored.agg(F.count(F.lit(1)).alias("total"),
                      F.coalesce(exact_avg(F.col("confidence")), F.lit(0.0)).alias("average_confidence"))


def fixed_domain_distribution(scored: DataFrame, col: str, domain: list[str], other: str | None = None) -> DataFrame:
    """Counts over a fixed domain (absent values -> 0), in domain order; ``other`` names a last row for all values outside.

    Shares are of all rows, whether in the domain or not.
    """
    if other is not None:
        known = F.when(F.col(col).isin(*domain), F.col(col)).otherwise(F.lit(other))
        return fixed_domain_distribution(scored.select(known.alias(col)), col, [*domain, other])
    spark = scored.sparkSession
    dom = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], "position int, label string")
    counts = scored.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    zero = dom.select("label", F.lit(0).cast("long").alias("n"))
    allc = counts.unionByName(zero).groupBy("label").agg(F.sum("n").alias("n"))
    allc = allc.withColumn("total", F.sum("n").over(Window.partitionBy()))  # few rows
    j = allc.join(F.broadcast(dom), "label")
    return j.select("position", "label", F.col("n").cast("long").alias("count"),
                    F.when(F.col("total") > 0, F.col("n") * F.lit(100.0) / F.col("total"))
                    .otherwise(F.lit(0.0)).alias("percentage"))


def first_n(df: DataFrame, n: int, order_col: str = "ID") -> DataFrame:
    """First n rows by ``order_col`` (top-k: TakeOrderedAndProject, no full sort)."""
    return df.orderBy(order_col).limit(n)


def omitted_count(df: DataFrame, n: int) -> DataFrame:
    """How many rows a first-n view leaves out."""
    return df.agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).cast("long").alias("omitted"))


def dedupe_in_order(df: DataFrame, value_col: str, order_col: str) -> DataFrame:
    """Distinct values in order of first appearance: (position, value)."""
    first = df.groupBy(F.col(value_col).alias("value")).agg(F.min(order_col).alias("first_seen"))
    w = Window.orderBy("first_seen")  # over the distinct values only
    return first.select(F.row_number().over(w).alias("position"), "value")
