"""Norm-bounded search for the nearest centres against numpy, by both ways the centres reach the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import search

WAYS = [search.CARRIED_BYTES, 0]


def brute(x, c):
    return np.sqrt(((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))


def tables(spark, x, c):
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, x array<double>")
    return rows, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "cluster_id long, v array<double>")


@pytest.mark.parametrize("way", WAYS)
def test_ten_thousand_centres(spark, way):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(10_000, 6)) * rng.uniform(0.2, 3, size=(10_000, 1))
    x = np.concatenate([rng.normal(size=(150, 6)), np.tile(c[7], (100, 1)), np.zeros((2, 6))])  # a hot point, and the origin
    rows, centres = tables(spark, x, c)
    got = search.nearest(rows, centres, F.col("x"), carried_bytes=way, rows_each=20).orderBy("row_id").collect()
    d = brute(x, c)
    assert [r["cluster_id"] for r in got] == d.argmin(axis=1).tolist()
    np.testing.assert_allclose([r["min_dist"] for r in got], d.min(axis=1), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("way", WAYS)
def test_confidence_and_margin(spark, way):
    rng = np.random.default_rng(6)
    c, x = rng.normal(size=(700, 3)), rng.normal(size=(60, 3))
    rows, centres = tables(spark, x, c)
    rows = rows.withColumn("own", F.when(F.col("row_id") == 3, F.lit(99_999)).otherwise(F.col("row_id") * 11).cast("long"))
    got = search.nearest(rows, centres, F.col("x"), facts=True, assigned_col="own", carried_bytes=way).orderBy("row_id").collect()
    d = brute(x, c)
    near = np.sort(d, axis=1)
    for r in got:
        i = r["row_id"]
        assert r["second_dist"] == pytest.approx(near[i, 1]) and r["max_dist"] == pytest.approx(near[i, -1])
        assert r["margin"] == pytest.approx(1 - near[i, 0] / near[i, 1])
        if i == 3:
            assert r["confidence"] is None
            continue
        raw = (1 - (d[i, i * 11] - near[i, 0]) / (near[i, -1] - near[i, 0])) * 100
        assert r["confidence"] == pytest.approx(min(95, max(30, raw)), abs=0.0501)


@pytest.mark.parametrize("way", WAYS)
def test_cases(spark, way):
    rows = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [None, 1.0], "b"), (3, [float("nan"), 1.0], "c"), (4, None, "d"), (4, [5.0, 5.0], "e"), (4, [5.0, 5.0], "e")],
                                 "row_id long, x array<double>, id string")
    centres = spark.createDataFrame([(9, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [0.0, -1.0]), (None, [0.0, 0.0]), (2, None), (1, [None, 0.0])], "cluster_id int, v array<double>")
    got = search.nearest(rows, centres, F.col("x"), facts=True, carried_bytes=way).collect()
    seen = sorted((r["row_id"], r["id"], r["cluster_id"], str(r["min_dist"])[:4], r["confidence"]) for r in got if r["row_id"] != 4 or r["id"] == "d")
    # a tie goes to the smallest id, and equal distances to all give the flat confidence
    assert seen[0][:4] == (1, "a", 4, "1.0") and seen[1] == (2, "b", 4, "None", None) and seen[2] == (3, "c", 4, "nan", None) and seen[3] == (4, "d", 4, "None", None)
    assert [(r["cluster_id"], r["id"]) for r in got if r["id"] == "e"] == [(4, "e")] * 2
    assert search.nearest(rows.where("false"), centres, F.col("x"), carried_bytes=way).count() == 0
    with pytest.raises(ValueError):
        search.nearest(rows, centres.where("false"), F.col("x"), carried_bytes=way)


def test_geometry_beyond_the_literals(spark):
    """Assignment, distances, silhouette, Davies-Bouldin, labels and scores with 90 centres as with few."""
    from cohort.operators import metrics as M
    from cohort.operators import score as S
    from cohort.operators.features import Scaler
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    c = M.Centroids(tuple(range(90)), ("a", "b"), tuple(map(tuple, rng.normal(size=(90, 2)).tolist())))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double")
    a = M.assign_nearest(df, c, keep_distances=True).cache()
    got = a.orderBy("row_id").toPandas()
    d = brute(x, np.array(c.values))
    assert got["cluster_id"].tolist() == d.argmin(axis=1).tolist()
    np.testing.assert_allclose(np.stack(got["distances"]), d)
    assert M.centroid_distances_long(df, c).where("row_id = 7").orderBy("cluster_id").toPandas()["distance"].tolist() == pytest.approx(d[7].tolist())
    vec = a.withColumn("x", F.array("a", "b"))
    assert M.silhouette_sq(a, ["a", "b"]).first()[0] == pytest.approx(M.silhouette_sq_vector(vec, "x").first()[0])
    assert M.davies_bouldin(a, ["a", "b"]).first()[0] == pytest.approx(M.davies_bouldin_vector(vec, "x").first()[0])
    plain = Scaler(("a", "b"), (0.0, 0.0), (1.0, 1.0))
    scored = S.score_rows(df, plain, c, [(i, f"L{i}") for i in range(89)]).toPandas().sort_values("row_id")
    assert scored["classification"].tolist() == [f"L{i}" if i < 89 else "Cluster 89" for i in d.argmin(axis=1)]
    near = np.sort(d, axis=1)
    np.testing.assert_allclose(scored["margin"], 1 - near[:, 0] / near[:, 1])
    assert set(scored["confidence"]) == {95.0}


def test_few_blocks_are_looked_at_where_norms_say_nothing(spark):
    """Centres on a sphere, all of one norm: a row far from most of them meets a small part of the blocks."""
    rng = np.random.default_rng(9)
    c = rng.normal(size=(8_000, 3))
    c /= np.sqrt((c * c).sum(axis=1))[:, None]
    _, centres = tables(spark, c[:1], c)
    blocks = search.box_blocks(centres, "cluster_id", "v")
    every = blocks.agg(F.collect_list(F.struct("lo", "hi"))).scalar()
    row = spark.createDataFrame([([float(v) for v in c[5] * 1.01],)], "x array<double>").withColumn("b", every)
    met = row.select(F.size("b").alias("n"), F.size(F.filter("b", lambda k: search._gap(k, F.col("x")) <= 0.05)).alias("near")).first()
    assert met["n"] > 20 and met["near"] <= met["n"] // 4
    assert blocks.agg(F.sum(F.size("members"))).first()[0] == 8_000
