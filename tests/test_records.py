"""Records over splits against Python's csv; a format per file; positions in input order."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from cohort.operators import gates as G
from cohort.sources import positions as PO
from cohort.sources import records as RE
from cohort.sources import scan as SC


@pytest.fixture()
def small_splits(spark):
    """Splits of some hundred bytes: records and quotes cross many of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def python_csv(text):
    """Records by Python's csv: too long ones dropped, short ones padded, empty cells null."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return sorted((tuple((c or None) for c in (r + [None] * len(rows[0]))[:len(rows[0])]) for r in rows[1:] if len(r) <= len(rows[0])), key=str)


def cell(rng):
    return rng.choice(["", "plain", 'say "hi"', "two\nlines", 'a\nb,"q"\r\n;z', '"', '""\n""', ",", "\n\n\n", "w" * rng.randint(1, 30)]) + str(rng.randint(0, 9))


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n")])
def test_records_equal_python_csv(spark, tmp_path, small_splits, seed, end):
    rng, out = random.Random(seed), io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "first name", "c"])
    writer.writerows([str(i), cell(rng), cell(rng)] for i in range(250))
    text = out.getvalue() + f'250,5" pipe,in"ch{end}251,short{end}252,one,cell,too many{end}{end}253,"last\none",x'
    write(tmp_path / "f.csv", text)
    df = RE.read_sheets(spark, str(tmp_path / "f.csv"), na_tokens=[], places=True)
    assert df.select("_split").distinct().count() > 8
    assert sorted((tuple(r)[3:] for r in df.collect()), key=str) == python_csv(text)


def test_quote_that_never_closes_is_dropped(spark, tmp_path, small_splits):
    write(tmp_path / "f.csv", 'a,b\n1,"x\ny"\n2,z\n3,"open\n' + "never,closed\n" * 200)
    assert sorted(tuple(r) for r in RE.read_sheets(spark, str(tmp_path / "f.csv")).collect()) == [("1", "x\ny"), ("2", "z")]


def test_one_long_record_over_many_splits(spark, tmp_path, small_splits):
    long = "line of text\n" * 300
    write(tmp_path / "f.csv", f'a,b\n1,"{long}"\n2,"{long}"\n3,z\n')
    got = {r["a"]: r["b"] for r in RE.read_sheets(spark, str(tmp_path / "f.csv")).collect()}
    assert got == {"1": long, "2": long, "3": "z"}


def test_format_per_file(spark, tmp_path):
    """UTF-8 with a real U+FFFD, with a byte order mark, Latin-1; other separators; columns in another order; one more column."""
    write(tmp_path / "a.csv", "id;nome\n1;José\n2;bad � cell\n")
    write(tmp_path / "b.csv", "nome,id\nJosé,3\n", "latin-1")
    write(tmp_path / "c.csv", '﻿"id"\tnome\tCPF\n4\tAna\t7\n', "utf-8")
    write(tmp_path / "d.csv", "id;nome\n")
    write(tmp_path / "e.csv", "")
    df = SC.read_many(spark, [str(tmp_path / "*.csv")])
    got = sorted(((r["id"], r["nome"], r["CPF"]) for r in df.collect()), key=str)
    assert got == [("1", "José", None), ("2", "bad � cell", None), ("3", "José", None), ("4", "Ana", "7")]
    assert SC.probe(spark, str(tmp_path / "a.csv")).encoding == "UTF-8" and SC.probe(spark, str(tmp_path / "b.csv")).encoding == "ISO-8859-1"


def test_no_lines_and_no_separator(spark, tmp_path):
    write(tmp_path / "e.csv", "")
    write(tmp_path / "one.csv", "alone\n1\n")
    for name in ("e.csv", "one.csv"):
        with pytest.raises(ValueError):
            RE.read_sheets(spark, str(tmp_path / name))


def test_two_reads_join_by_position(spark, tmp_path, small_splits):
    for k in range(3):
        write(tmp_path / f"part-{k}.csv", "id,text\n" + "".join(f'{100 * k + i},"{i}\n{i}"\n' if i % 7 == 0 else f"{100 * k + i},t{i}\n" for i in range(100)))
    a, b = (PO.sheet_positions(RE.read_sheets(spark, str(tmp_path), places=True)) for _ in range(2))
    got = sorted((r["position"], int(r["id"]), int(r["other"])) for r in a.join(b.select("position", F.col("id").alias("other")), "position").collect())
    assert got == [(i + 1, i, i) for i in range(300)]


def test_file_positions_and_case_numbers(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    df.orderBy(F.desc("row_id")).write.parquet(str(tmp_path / "t"))
    got = sorted((r["position"], r["row_id"]) for r in PO.file_positions(spark, str(tmp_path / "t")).collect())
    assert got == [(i + 1, 999 - i) for i in range(1000)]
    numbers = G.case_number(df.where("row_id % 3 = 0"))
    assert sorted((r["row_id"], r["case_no"]) for r in numbers.collect()) == [(i, i // 3 + 1) for i in range(0, 1000, 3)]
    assert "Window" not in numbers._jdf.queryExecution().executedPlan().toString()
    assert G.case_number(df.where("false")).count() == 0


def test_sheet_number_is_an_identifier(spark):
    df = spark.createDataFrame([("7", None), ("8", " ")], "ID_Atendido string, CPF string")
    assert G.identifier_pick(df).first()[0] == "ID_Atendido"
