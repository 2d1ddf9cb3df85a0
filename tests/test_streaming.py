"""File-drop scorer: CSV sheets dropped in a folder are scored like the batch scorer."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort import contract as K
from cohort.plans import jobs
from cohort.plans.intake import intake, to_sheet
from cohort.sources import scan as SC
from cohort.streaming.score_stream import start_scoring


def test_csv_drop_scored_like_batch(spark, small, tmp_path):
    cells = intake(spark, small)
    model, _ = jobs.train(cells, n_init=2)
    sheet = to_sheet(cells)
    src = str(tmp_path / "in")
    SC.write_delimited(sheet.where(F.col("row_id") < 700), src + "/a", sep=";")
    SC.write_delimited(sheet.where(F.col("row_id") >= 700), src + "/b", sep=";")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in sheet.columns])
    q = start_scoring(spark, src + "/*", str(tmp_path / "out"), str(tmp_path / "ckpt"), model, schema,
                      keep=["row_id"], fmt="csv", sep=";")
    q.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select(
        F.col("row_id").cast("long").alias("row_id"), "cluster_id", "classification", "risk_level")
    # batch reference: the same CSV files read in batch and scored
    fmt = SC.probe(spark, src + "/a")
    from cohort.operators.gates import resolve_headers
    batch_cells = resolve_headers(SC.read_delimited(spark, [src + "/a", src + "/b"], fmt))
    batch = jobs.score(batch_cells, model, keep=["row_id"]).select(
        F.col("row_id").cast("long").alias("row_id"), "cluster_id", "classification", "risk_level")
    assert streamed.count() == cells.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert {r[0] for r in streamed.select("risk_level").distinct().collect()} <= {"Baixo", "Médio", "Alto"}
    labels = {lab for _, _, lab in model.labels}
    assert {r[0] for r in streamed.select("classification").distinct().collect()} <= labels


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert df.columns == ["row_id", "nome", "cpf", "cluster_id", "classification", "confidence", "risk_level"]
    assert all(30.0 <= r["confidence"] <= 95.0 or r["confidence"] == 50.0 for r in rows)
    assert {r["classification"] for r in rows} <= {K.LABEL_RELEASE, K.LABEL_MONITOR, K.LABEL_INTENSIVE,
                                                   K.LABEL_SINGLE}
