"""Exact quantiles by rank selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import profile as P
from cohort.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(df, features, by, got):
    rows = df.toPandas()
    groups = rows.groupby(by[0]) if by else [(None, rows)]
    want = {}
    for g, part in groups:
        for f in features:
            x = part[f].dropna().to_numpy(float)
            for p in PROBS:
                if len(x):
                    want[g, f, p] = (len(x), np.quantile(x, p))
    have = {((r[by[0]] if by else None), r["feature"], r["p"]): (r["n"], r["value"]) for r in got.collect()}
    assert have.keys() == want.keys()
    for k, (n, v) in want.items():
        assert have[k][0] == n and have[k][1] == pytest.approx(v, rel=1e-12, abs=1e-12), k


@pytest.mark.parametrize("small,cells", [(50_000, 64), (100, 16)])
def test_quantiles_by_group(spark, small, cells):
    """Continuous, skewed, few-valued, one-valued and sparse features; one group holds most rows; ranges of one value and of many."""
    x = F.xxhash64("id").cast("double")
    df = spark.range(3000).select(F.when(F.col("id") < 2100, 0).otherwise(F.col("id") % 4).alias("g"), (x / 1e18).alias("a"), F.exp(x / 2e17).alias("skew"), (F.col("id") % 7).cast("double").alias("few"),
                                  F.lit(2.5).alias("one"), F.when(F.col("id") % 97 == 0, x).alias("sparse"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(x / 1e17).alias("hot"),
                                  F.lit(None).cast("double").alias("none")).persist()
    features = ["a", "skew", "few", "one", "sparse", "hot", "none"]
    check(df, features, ["g"], exact_quantiles(df, features, PROBS, ["g"], small=small, cells=cells))
    check(df, features, [], exact_quantiles(df, features, PROBS, small=small, cells=cells))
    df.unpersist()


def test_a_million_values_in_one_group(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), F.xxhash64("id").cast("double").alias("a"))
    got = exact_quantiles(df, ["a"], [0.25, 0.5], ["g"])
    x = np.array([r[0] for r in df.select("a").collect()])
    assert [r["value"] for r in got.orderBy("p").collect()] == pytest.approx([np.quantile(x, 0.25), np.quantile(x, 0.5)], rel=1e-13)


def test_no_group_is_gathered(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("int").alias("cluster_id"), F.col("id").cast("double").alias("a"))
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (P.profile_numeric(df, ["a"]), P.feature_summary(df, ["a"]))]
    assert not any("percentile(" in p or "collect_" in p for p in plans)
    rows = {r["cluster_id"]: r["median"] for r in P.profile_numeric(df, ["a"]).collect()}
    assert rows == {0: 49.5, 1: 49.0, 2: 50.0}


def test_empty_null_and_nan(spark):
    none = spark.createDataFrame([], "g int, a double")
    assert exact_quantiles(none, ["a"], [0.5], ["g"]).count() == 0
    row = P.feature_summary(none, ["a"]).first()
    assert row["count"] == 0 and row["p50"] is None
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, float("nan")), (1, 2.0), (1, None), (1, 1.0)], "g int, a double")
    got = {r["g"]: r["value"] for r in exact_quantiles(df, ["a"], [0.5], ["g"]).collect()}
    assert got == {None: 2.0, 1: 2.0}
