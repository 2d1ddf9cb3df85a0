"""Geometry against brute force (numpy) on small fixtures derived from the driver tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.operators import features as FE
from cohort.operators import metrics as M
from cohort.plans.intake import AS_OF, intake

FEATS = K.FEATURE_NAMES


@pytest.fixture(scope="module")
def zdata(spark, small):
    fm = FE.feature_matrix(intake(spark, small), AS_OF).withColumn("grp", F.col("education_level"))
    sc = FE.scaler_fit(fm, FEATS)
    z = FE.standardize(fm, sc, keep=["row_id", "grp"]).cache()
    cents = M.Centroids.from_df(M.group_centroids(z, FEATS, "grp"), FEATS)
    a = M.assign_nearest(z, cents).cache()
    pdf = a.toPandas().sort_values("row_id")
    return fm, sc, z, cents, a, pdf


def test_scaler_population_std(spark, zdata):
    fm, sc, *_ = zdata
    x = fm.select(*FEATS).toPandas().to_numpy(dtype=float)
    np.testing.assert_allclose(sc.means, x.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(sc.stds, x.std(axis=0, ddof=0), rtol=1e-9)
    # zero variance -> scale 1
    const = spark.createDataFrame([(1.0,), (1.0,)], "age double")
    s = FE.scaler_fit(const, ["age"])
    assert s.scales == (1.0,)


def test_standardized_moments(zdata):
    *_, pdf = zdata
    x = pdf[FEATS].to_numpy(dtype=float)
    np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(x.std(axis=0), 1, atol=1e-9)


def test_nearest_is_argmin(zdata):
    _, _, _, cents, _, pdf = zdata
    x = pdf[FEATS].to_numpy(dtype=float)
    c = np.array(cents.values)
    d2 = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    np.testing.assert_array_equal(pdf["cluster_id"].to_numpy(), np.array(cents.ids)[d2.argmin(axis=1)])
    np.testing.assert_allclose(pdf["min_sq_dist"].to_numpy(), d2.min(axis=1), rtol=1e-9)


def _silhouette_sq_brute(x, labels):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        n_own = own.sum()
        if n_own == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (n_own - 1)
        b = min(d[i, labels == c].mean() for c in np.unique(labels) if c != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def _db_brute(x, labels):
    ids = np.unique(labels)
    cen = np.array([x[labels == c].mean(axis=0) for c in ids])
    s = np.array([np.sqrt(((x[labels == c] - cen[i]) ** 2).sum(axis=1)).mean() for i, c in enumerate(ids)])
    dist = np.sqrt(((cen[:, None] - cen[None]) ** 2).sum(axis=2))
    dist[dist == 0] = np.inf
    return float(np.max((s[:, None] + s[None]) / dist, axis=1).mean())


def test_silhouette_sq_matches_brute_force(zdata):
    *_, a, pdf = zdata
    got = M.silhouette_sq(a, FEATS).first()[0]
    want = _silhouette_sq_brute(pdf[FEATS].to_numpy(dtype=float), pdf["cluster_id"].to_numpy())
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert -1.0 <= got <= 1.0


def test_davies_bouldin_matches_brute_force(zdata):
    *_, a, pdf = zdata
    got = M.davies_bouldin(a, FEATS).first()[0]
    want = _db_brute(pdf[FEATS].to_numpy(dtype=float), pdf["cluster_id"].to_numpy())
    assert got == pytest.approx(want, rel=1e-9)


def test_single_cluster_guards(spark, zdata):
    *_, a, _ = zdata
    one = a.withColumn("cluster_id", F.lit(0))
    assert M.silhouette_sq(one, FEATS).first()[0] == 0.0
    assert M.davies_bouldin(one, FEATS).first()[0] == float("inf")


def test_confidence_formula(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 1), ([1.0, 2.0, 3.0], 2), ([1.0, 2.0, 3.0], 3),
                                ([2.0, 2.0], 1), ([1.0, 1.001, 9.0], 2)], "d array<double>, a int")
    got = [r[0] for r in df.select(M.confidence(F.col("d"), F.col("a"))).collect()]
    assert got == [95.0, 50.0, 30.0, 50.0, 95.0]


def test_vector_metrics_match_brute_force(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    pdf = e.toPandas()
    x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    lab = pdf["label"].to_numpy()
    got = M.silhouette_sq_vector(e, "embedding", "label").first()[0]
    assert got == pytest.approx(_silhouette_sq_brute(x, lab), rel=1e-9, abs=1e-12)
    got_db = M.davies_bouldin_vector(e, "embedding", "label").first()[0]
    assert got_db == pytest.approx(_db_brute(x, lab), rel=1e-9)


def test_sweep_metrics_equal_those_of_each_model(spark, small):
    """All models in two passes: the same values as one model at a time, and as numpy for the centroid silhouette."""
    from cohort.operators.kmeans import choose_k
    from cohort.operators.sweep import sweep_metrics
    from cohort.plans import queries as Q

    fm, _, z = Q.fitted(spark, small)
    cents = Q.fixed_centroids(z)
    models = {k: M.Centroids(cents.ids[:k], cents.features, cents.values[:k]) for k in (1, 2, 3, 4)}
    got = {r["k"]: r for r in sweep_metrics(z, models, Q.FEATS).collect()}
    x = np.array(z.select(*Q.FEATS).collect(), float)
    for k, c in models.items():
        a = M.assign_nearest(z, c)
        assert got[k]["inertia"] == pytest.approx(M.inertia(a).first()[0], rel=1e-10)
        assert got[k]["silhouette"] == pytest.approx(M.silhouette_sq(a, Q.FEATS).first()[0], abs=1e-10)
        assert got[k]["davies_bouldin"] == pytest.approx(M.davies_bouldin(a, Q.FEATS).first()[0], rel=1e-10)
        d = np.sort(np.sqrt(((x[:, None] - np.array(c.values)[None]) ** 2).sum(axis=2)), axis=1)
        want = ((d[:, 1] - d[:, 0]) / d[:, 1]).mean() if k > 1 else 0.0
        assert got[k]["centroid_silhouette"] == pytest.approx(want, abs=1e-10)
    table = sweep_metrics(z, models, Q.FEATS)
    best = max(got.values(), key=lambda r: (r["centroid_silhouette"], -r["k"]))["k"]
    assert choose_k(table, floor=-1.0, metric="centroid_silhouette").first()["best_k"] == best
    assert sweep_metrics(z, {}, Q.FEATS).count() == 0
    fm.unpersist()


def test_sweep_leaves_out_k_beyond_the_different_points(spark):
    from cohort.operators import kmeans as KM

    z = spark.createDataFrame([(float(i % 3), 0.0) for i in range(60)], "a double, b double")
    v = KM.persist_vectors(z, ["a", "b"])
    metrics, fits = KM.k_sweep(v, ["a", "b"], [2, 3, 4, 5], n_init=2)
    assert sorted(fits) == [2, 3] and {r["k"]: round(r["inertia"], 9) for r in metrics.collect()}[3] == 0.0
    v.unpersist()
