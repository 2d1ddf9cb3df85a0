"""What the fits, sums and reports read, and how often."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from cohort.functions import cells as C
from cohort.functions.sums import exact_sum, long_sums
from cohort.operators import kmeans as KM
from cohort.plans import intake as I
from cohort.plans import queries as Q


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fits_move_together_and_end_like_sparks_own(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(loc=m, size=(300, 2)) for m in (0, 3, 9)])
    v = KM.persist_vectors(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(4), ["a", "b"])
    passes = []
    move = KM._move
    monkeypatch.setattr(KM, "_move", lambda rows, sets: passes.append(len(sets)) or move(rows, sets))
    tasks = [(k, s) for k in (2, 3, 4) for s in (42, 43, 44)]
    fits = KM.fit_all(v, tasks)
    assert passes[0] == len(tasks) and passes == sorted(passes, reverse=True) and len(passes) <= 60  # those of the slowest fit
    for f in fits:
        own = KMeans(k=f.k, seed=f.seed, maxIter=300, tol=KM.spark_tol(f.k), featuresCol="features", predictionCol="_pred").fit(v)
        np.testing.assert_allclose(f.model.clusterCenters(), own.clusterCenters(), rtol=1e-9, atol=1e-12)
        assert f.cost == pytest.approx(own.summary.trainingCost, rel=1e-9)
        assert f.model.transform(v).where("_pred is null").count() == 0
    v.unpersist()


def test_sums_by_blocks_are_the_exact_ones(spark):
    rows = [(i % 3 if i % 7 else None, (-1.0) ** i * 10.0 ** (i % 22 - 10), None if i % 5 else 0.1) for i in range(500)] + [(8, None, None), (9, float("inf"), 1e300), (9, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(4)
    got = long_sums(df, {"a": F.col("a"), "b": F.col("b")}, ["g"])
    assert "Generate" not in plan(got)  # no row is turned into one per column
    want = df.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), *[e for c in "ab" for e in (exact_sum(F.col(c)).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert tuple(long_sums(df.where("false"), {"a": F.col("a")}).first()) == (None, None, 0)


def test_a_cell_is_worked_out_once(spark):
    df = spark.createDataFrame([("R$ 1.500,50", "Sim", "Álcool", "25 "), (None, " ", "nan", "x")], "remuneracao string, procurando_trabalho string, uso_drogas string, idade string")
    rec = {c: F.col(c) for c in ("remuneracao", "procurando_trabalho", "idade")}
    out = df.select(C.observed_factors(rec, C.dependency_info("uso_drogas")).alias("o"))
    for c in df.columns:
        assert plan(out).split("LogicalRDD")[0].count(f"{c}#") == 1, c
    assert [r["o"] for r in out.collect()] == [
        ["Idade informada: 25", "Renda declarada: R$ 1.500,50", "Busca por trabalho: Sim", "Dependência química relatada: Álcool"],
        ["Idade informada: x", "Dependência química: não há registro atualizado no cadastro."]]


def test_tasks_take_bounded_shares_of_a_sheet(spark, small, monkeypatch):
    monkeypatch.setattr(I, "ROWS_PER_TASK", 40)
    sheet = I.intake(spark, small)
    n = sheet.count()
    assert sheet.rdd.getNumPartitions() >= n / 40 and sheet.select("row_id").distinct().count() == n


def test_only_features_are_persisted(spark, small):
    spark.catalog.clearCache()
    Q.scored(spark, small)
    text = Q.scored(spark, small)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" not in text  # the cells are read by the pass that gives them out
    assert "nome" not in str(Q.features_assigned(spark, small)[0].columns)
    spark.catalog.clearCache()


def test_written_sheets_take_more_files_as_they_grow(spark, small, monkeypatch):
    import glob
    from cohort.plans import queries2 as Q2
    files, read = [], Q2.SC.read_many
    monkeypatch.setattr(Q2.SC, "read_many", lambda s, path: files.append(len(glob.glob(f"{path}/*.txt"))) or read(s, path))
    few = Q2.q_scan_bad_lines(spark, small)
    monkeypatch.setattr(I, "ROWS_PER_TASK", 50)
    many = Q2.q_scan_bad_lines(spark, small)
    assert files[1] > 2 * files[0] and many.count() == few.count() > 0
    assert many.exceptAll(few).count() == 0 and few.exceptAll(many).count() == 0
