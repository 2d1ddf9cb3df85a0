"""Starting centres of many fits in shared passes against pyspark.ml's own, and the jobs that fits take."""

import uuid

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array

from cohort.operators import blocks as B
from cohort.operators import kmeans as KM
from cohort.operators import starts as S


def vectors(spark, x, parts):
    names = [f"c{i}" for i in range(x.shape[1])]
    return KM.persist_vectors(spark.createDataFrame([tuple(map(float, r)) for r in x], [*names]).repartition(parts), names)


@pytest.mark.parametrize("seed", [0, 42, -7, 2**40 + 5])
def test_draws_are_those_of_spark_and_java(spark, seed):
    theirs = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
    draws = S.Draws(seed)
    assert np.concatenate([draws.take(3), draws.take(50), draws.take(1)]).tolist() == [theirs.nextDouble() for _ in range(54)]
    assert S.first_int(seed) == spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    theirs, ours = spark._jvm.java.util.Random(seed), S.JavaRandom(seed)
    assert [ours.int(), ours.long(), ours.double(), ours.below(7), ours.below(8)] == [theirs.nextInt(), theirs.nextLong(), theirs.nextDouble(), theirs.nextInt(7), theirs.nextInt(8)]


@pytest.mark.parametrize(("n", "few"), [(600, 0), (600, 1 << 20), (30, 1 << 20), (1, 1 << 20)])
def test_starts_are_those_of_sparks_own(spark, monkeypatch, n, few):
    """Both where tasks pass over the rows and where the driver does; too few points give fewer centres."""
    monkeypatch.setattr(B, "FEW_BYTES", few)
    v = vectors(spark, np.random.default_rng(n).normal(size=(n, 3)), 3)
    v.count()
    rows = B.kept(B.packed(v, vector_to_array("features")))
    assert (rows.here is not None) == bool(few) and sum(rows.counts) == n
    tasks = [(2, 42), (5, 43)]
    for (k, seed), got in zip(tasks, S.starts(rows, tasks), strict=True):
        own = KMeans(k=k, seed=seed, maxIter=0, solver="block", predictionCol="_pred").fit(v).clusterCenters()
        np.testing.assert_allclose(got, own, rtol=1e-9, atol=1e-12)
    rows.unpersist()
    v.unpersist()


def test_equal_rows_give_one_centre_and_none_raise(spark):
    v = vectors(spark, np.ones((50, 2)), 2)
    assert [len(f.model.centres) for f in KM.fit_all(v, [(2, 1), (3, 2)])] == [1, 1]
    with pytest.raises(ValueError):
        KM.kmeans_fit(v.where("false"), 2, n_init=1)
    v.unpersist()


def test_jobs_do_not_grow_with_restarts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = vectors(spark, np.concatenate([rng.normal(loc=m, size=(200, 2)) for m in (0, 4)]), 4)
    v.count()

    def jobs(n_init):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "fits")
        fits = KM.kmeans_restarts(v, 2, n_init=n_init)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext._jsc.clearJobGroup()
        assert len(fits) == n_init
        return found

    assert jobs(10) <= jobs(1) <= 8  # each restart had jobs of its own, and each pass over few rows
    monkeypatch.setattr(B, "FEW_BYTES", 0)
    few, many = KM.kmeans_restarts(v, 2, n_init=2), KM.kmeans_restarts(v, 2, n_init=2)
    assert [f.cost for f in few] == pytest.approx([f.cost for f in many], rel=1e-12)
    v.unpersist()


def test_ties_go_to_the_first_centre(spark):
    x = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    rows = B.Blocks(None, [4], [(0, x)])
    (moved, cost), (same, _) = KM._move(rows, [np.array([[0.0, 0.0], [2.0, 0.0], [9.0, 9.0]]), np.array([[1.0, 0.0]])])
    np.testing.assert_allclose(moved, [[2 / 3, 0.0], [2.0, 0.0], [9.0, 9.0]])
    assert cost == pytest.approx(2.0) and same.tolist() == [[1.0, 0.0]]
