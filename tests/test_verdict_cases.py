"""Cases that once gave silent or plan-dependent results."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cohort.operators import gates, metrics, profile
from cohort.sources import scan


def brute_silhouette(points, label):
    points, label = np.asarray(points, float), np.asarray(label)
    total = 0.0
    for i, p in enumerate(points):
        d = ((points - p) ** 2).sum(axis=1)
        own = label == label[i]
        if own.sum() > 1:
            a = d[own].sum() / (own.sum() - 1)
            b = min(d[label == c].mean() for c in set(label) - {label[i]})
            total += 0.0 if a == b else 1 - a / b if a < b else b / a - 1
    return total / len(points)


@pytest.mark.parametrize("groups,dims", [(60, 5000), (200, 16)])
def test_vector_silhouette_of_many_groups_and_positions(spark, groups, dims):
    points = [[float(g * 10 + (j == g % dims) + 0.5 * k) for j in range(dims)] for g in range(groups) for k in range(2)]
    label = [g for g in range(groups) for _ in range(2)]
    df = spark.createDataFrame(list(zip(label, points, strict=True)), "cluster_id int, v array<double>")
    assert metrics.silhouette_sq_vector(df, "v").first()[0] == pytest.approx(brute_silhouette(points, label), abs=1e-6)


def test_zero_separation_and_identical_points(spark):
    df = spark.createDataFrame([(k % 2, [0.1, 0.7, 0.3]) for k in range(7)], "cluster_id int, v array<double>")
    wide = df.select("cluster_id", *[F.col("v")[i].alias(f"x{i}") for i in range(3)])
    assert metrics.davies_bouldin_vector(df, "v").first()[0] == 0.0
    assert metrics.silhouette_sq_vector(df, "v").first()[0] == 0.0
    assert metrics.silhouette_sq(wide, ["x0", "x1", "x2"]).first()[0] == 0.0


@pytest.mark.parametrize("rows,buckets", [(0, 4), (1, 4), (9, 1), (100, 7)])
def test_case_numbers_on_empty_input_and_one_bucket(spark, rows, buckets):
    df = spark.range(rows).select((F.col("id") * 3).alias("row_id"))
    got = sorted((r["row_id"], r["case_no"]) for r in gates.case_number(df, buckets=buckets).collect())
    assert got == [(3 * k, k + 1) for k in range(rows)]


def test_means_do_not_depend_on_the_plan(spark, small):
    from cohort.contract import FEATURE_NAMES
    df = spark.range(2000).select((F.col("id") % 3).cast("int").alias("cluster_id"), *[
        (F.when(F.col("id") % 4 == 0, 0.6).when(F.col("id") % 4 == 1, 1.0).otherwise(0.1) + F.lit(0.0)).alias(f) for f in FEATURE_NAMES])
    found = [sorted(map(tuple, profile.cluster_means(df.repartition(n), FEATURE_NAMES).collect())) for n in (1, 4, 16)]
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("name", ["predictions_text", "record_report_lines", "batch_report_lines", "predictions_csv"])
def test_no_full_cpf_in_reports(spark, small, name):
    rows = E.queries()[name](spark, small).collect()
    assert rows and not any(re.search(r"(?<!\d)\d{11}(?!\d)|\d{3}\.\d{3}\.\d{3}-\d{2}", str(v)) for r in rows for v in r)


def test_quotes_separators_and_backslashes_survive(spark, tmp_path):
    cells = [("1", 'he said "x, y" ok', "3"), ("2", "C:\\", "z"), ("3", "a;b", 'q"')]
    df = spark.createDataFrame(cells, "a string, b string, c string").repartition(2)
    scan.write_delimited(df, str(tmp_path / "out"))
    back = scan.read_delimited(spark, str(tmp_path / "out"), scan.Format("UTF-8", ",", ("a", "b", "c")))
    assert sorted(map(tuple, back.collect())) == sorted(cells)


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,"two\nlines"\n')
    back = scan.read_delimited(spark, str(path), scan.Format("UTF-8", ",", ("a", "b")), multi_line=True)
    assert [tuple(r) for r in back.collect()] == [("1", "two\nlines")]


def test_encoding_is_decided_by_the_whole_file(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"id,nome\n" + b"1,Ana\n" * 300 + "2,José\n".encode("latin-1"))
    fmt = scan.probe(spark, str(path))
    assert [r["nome"] for r in scan.read_delimited(spark, str(path), fmt).where("id = '2'").collect()] == ["José"]
