"""Sums that don't depend on partitions or order."""

import math
import random

from pyspark.sql import functions as F

from cohort.functions.sums import exact_avg, exact_sum
from cohort.operators import features as FE
from cohort.operators import metrics as M
from cohort.operators import profile as P
from cohort.plans import queries as Q


def values(seed):
    rng = random.Random(seed)
    return [rng.choice([rng.gauss(0, 1), rng.gauss(1e6, 3), rng.expovariate(1) * 1e-9, -rng.random() * 1e12, 0.1, -0.1]) for _ in range(4000)]


def test_sum_is_exact_and_order_free(spark):
    xs = values(4)
    df = spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "x double, i int")
    got = {df.repartition(n, "i").orderBy(o).agg(exact_sum(F.col("x")), exact_avg(F.col("x"))).first() for n in (1, 4, 16) for o in ("x", "i")}
    assert len(got) == 1
    total, mean = got.pop()
    assert math.isclose(total, math.fsum(xs), rel_tol=1e-15) and math.isclose(mean, math.fsum(xs) / len(xs), rel_tol=1e-15)


def test_cancellation_large_values_and_nulls(spark):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(exact_sum(F.col("x"))).first()[0]
    assert one(1e14, 1.0, -1e14, 2.0**-60) == 1.0 + 2.0**-60
    assert one(1e300, 1.0) == 1e300 and one(float("inf"), 1.0) == math.inf and math.isnan(one(float("nan"), 1.0))
    assert one(None, 2.5, -0.5) == 2.0 and one(None) is None
    assert spark.range(0).agg(exact_sum(F.col("id")), exact_avg(F.col("id"))).first() == (None, None)


def test_fits_are_bit_equal_under_any_partitioning(spark, small):
    fm, _, _ = Q.fitted(spark, small)
    found = []
    for n in (1, 4, 16):
        rows = fm.repartition(n)
        scaler = FE.scaler_fit(rows, Q.FEATS)
        z = FE.standardize(rows, scaler, keep=["row_id", "grp"])
        a = M.assign_nearest(z, Q.fixed_centroids(z))
        raw = a.select("row_id", "cluster_id").join(rows, "row_id")
        scores = sorted(tuple(r) for r in P.cluster_score(P.cluster_means(raw, Q.FEATS)).collect())
        found.append((scaler, M.inertia(a).first()[0], M.silhouette_sq(a, Q.FEATS).first()[0], M.davies_bouldin(a, Q.FEATS).first()[0], scores))
    assert found[0] == found[1] == found[2]
    fm.unpersist()
