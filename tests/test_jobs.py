"""Training/scoring invariants (the rows-only operators): cost, assignment, labels, sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.operators import gates as G
from cohort.operators import kmeans as KM
from cohort.operators import profile as P
from cohort.plans import jobs
from cohort.plans.intake import intake


@pytest.fixture(scope="module")
def trained(spark, small):
    cells = intake(spark, small)
    model, assigned = jobs.train(cells, n_init=3)
    return cells, model, assigned


def test_model_shape(trained):
    cells, model, assigned = trained
    k = model.centroids.k
    assert 1 <= k <= K.K_MAX
    assert model.selected_k in range(K.K_MIN, K.K_MAX + 1)
    if model.best_k_score is not None and model.best_k_score < K.SILHOUETTE_FLOOR:
        assert model.selected_k == K.FALLBACK_K
    assert len(model.labels) == k
    ranks = sorted(lab for _, _, lab in model.labels)
    if k >= 3:
        assert ranks.count(K.LABEL_RELEASE) == 1 and ranks.count(K.LABEL_MONITOR) == 1
    assert model.total_records == cells.count()


def test_sweep_metrics_sane(trained):
    _, model, _ = trained
    for k, inertia, sil, db in model.sweep:
        assert inertia >= 0 and -1.0 <= sil <= 1.0 and db >= 0


def test_sizes_sum_and_shares(trained):
    cells, model, assigned = trained
    sizes = P.cluster_size(assigned, list(model.centroids.ids)).toPandas()
    assert sizes["size"].sum() == cells.count()
    assert sizes["percentage"].sum() == pytest.approx(100.0)


def test_scoring_training_set_reproduces_assignment(spark, trained):
    cells, model, assigned = trained
    scored = jobs.score(cells, model, keep=["row_id"])
    a = assigned.select("row_id", F.col("cluster_id").alias("train_id"))
    j = scored.join(a, "row_id")
    assert j.where(F.col("cluster_id") != F.col("train_id")).count() == 0
    # nearest cluster => confidence is the clamp maximum unless all distances tie
    assert set(r[0] for r in scored.select("confidence").distinct().collect()) <= {95.0, 50.0}


def test_roundtrip_and_partitioning_invariance(spark, trained, tmp_path):
    cells, model, _ = trained
    path = str(tmp_path / "model")
    jobs.save(model, spark, path)
    loaded = jobs.load(spark, path)
    a = jobs.score(cells.repartition(1), loaded, keep=["row_id"]).select("row_id", "cluster_id", "classification")
    b = jobs.score(cells.repartition(16), model, keep=["row_id"]).select("row_id", "cluster_id", "classification")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_restart_picks_least_cost(spark, trained):
    from cohort.plans.queries2 import _intake_vectors
    v = _intake_vectors(spark, "/root/testdata/sf0.001")
    fits = KM.kmeans_restarts(v, 3, n_init=3)
    best = KM.kmeans_fit(v, 3, n_init=3)
    assert best.cost == pytest.approx(min(f.cost for f in fits), rel=1e-9)


def test_choose_k_rules(spark):
    m = spark.createDataFrame([(2, 1.0, 0.30, 1.0), (3, 1.0, 0.40, 1.0), (4, 1.0, 0.40, 1.0)],
                              "k int, inertia double, silhouette double, davies_bouldin double")
    r = KM.choose_k(m).first()
    assert (r["best_k"], r["selected_k"]) == (3, 3)  # first maximum
    low = spark.createDataFrame([(2, 1.0, 0.05, 1.0), (3, 1.0, 0.10, 1.0)],
                                "k int, inertia double, silhouette double, davies_bouldin double")
    r = KM.choose_k(low).first()
    assert (r["best_k"], r["selected_k"], r["selected_k_score"]) == (3, 2, 0.05)


def test_case_number_is_dense_and_ordered(spark, small):
    df = intake(spark, small).select("row_id").repartition(5)
    got = G.case_number(df).orderBy("row_id").toPandas()
    np.testing.assert_array_equal(got["case_no"].to_numpy(), np.arange(1, len(got) + 1))


def test_case_number_stable_when_persisted(spark, small):
    from pyspark import StorageLevel
    df = intake(spark, small).select("row_id").repartition(7)
    got = G.case_number(df, buckets=5).persist(StorageLevel.MEMORY_AND_DISK)
    pdf = got.orderBy("row_id").toPandas()
    np.testing.assert_array_equal(pdf["case_no"].to_numpy(), np.arange(1, len(pdf) + 1))
    assert got.count() == df.count()
    got.unpersist()
