"""Numeric customer features from customer ⟕ orders ⟕ lineitem.

Plan shape (checked with ``explain``): lineitem is pre-aggregated per order
(partial + final hash aggregate) BEFORE the join, so the join and the
per-customer aggregate see one row per order; a customer holding a third of
all orders only grows one partial-aggregate buffer per task.  The customer
side is joined on its key after aggregation (one row per customer on both
sides, no skewed join key).  ``as_of`` is one global min/max aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.plans.intake import read_table

CUSTOMER_FEATURES = ["c_acctbal", "n_orders", "spend", "avg_discount", "days_since_last"]


def customer_features(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    orders = read_table(spark, sf, "orders")
    cust = read_table(spark, sf, "customer")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum("l_discount").alias("disc_sum"), F.count(F.lit(1)).alias("n_lines"))
    o = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    oj = o.join(per_order, o["o_orderkey"] == per_order["l_orderkey"], "left")
    per_cust = oj.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("spend"),
        (F.sum("disc_sum") / F.sum("n_lines")).alias("avg_discount"),
        F.max("d").alias("last_order"))
    span = orders.agg(F.max(F.to_date("o_orderdate")).alias("hi"), F.min(F.to_date("o_orderdate")).alias("lo")).first()
    hi, lo = span["hi"], span["lo"]
    never = (hi - lo).days if hi and lo else 0
    j = cust.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").join(
        per_cust, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select(
        "c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("double"),
        F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"),
        F.coalesce("spend", F.lit(0.0)).alias("spend"),
        F.coalesce("avg_discount", F.lit(0.0)).alias("avg_discount"),
        F.coalesce(F.datediff(F.lit(hi), F.col("last_order")), F.lit(never)).cast("int")
        .alias("days_since_last"))
