"""Delimited-text sources: probe (BOM, Latin-1, separators), bad lines, NA tokens, landing."""

import pytest
from pyspark.sql import functions as F

from cohort.operators import gates as G
from cohort.sources import scan as SC


def _write(path, text, encoding):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


@pytest.mark.parametrize("encoding,sep", [("utf-8-sig", ","), ("latin-1", ";"), ("utf-8", "\t")])
def test_probe_and_read(spark, tmp_path, encoding, sep):
    rows = ["Nome{s}Idade{s}Bolsa Família", "Ana{s}30{s}Sim", "José{s}NA{s}Não"]
    p = tmp_path / "sheet.csv"
    _write(p, "\n".join(r.format(s=sep) for r in rows) + "\n", encoding)
    fmt = SC.probe(spark, str(p))
    assert fmt.sep == sep
    df = G.resolve_headers(SC.read_delimited(spark, str(p), fmt))
    assert df.columns == ["nome", "idade", "bolsa_familia"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("Ana", "30", "Sim"), ("José", None, "Não")]


def test_bad_lines_policy(spark, tmp_path):
    p = tmp_path / "bad.csv"
    _write(p, 'a,b,c\n1,2,3\n4,5,6,7\n8,9\n"x,y",z,w\n', "utf-8")
    fmt = SC.probe(spark, str(p))
    got = sorted(tuple(r) for r in SC.read_delimited(spark, str(p), fmt).collect())
    assert got == [("1", "2", "3"), ("8", "9", None), ("x,y", "z", "w")]


def test_land_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    a = SC.land(df, str(tmp_path), "in")
    b = SC.land(df, str(tmp_path), "in")
    assert a.endswith("in_convertido") and b.endswith("in_convertido_1")
    assert spark.read.parquet(b).count() == 3


def test_gates(spark):
    df = spark.createDataFrame([(None, " "), ("nan", None)], "Nome string, CPF string")
    assert G.has_meaningful_data(df).first()[0] is False
    assert G.identifier_detect(df).count() == 0
    df2 = spark.createDataFrame([(None, "123"), ("none", None)], "Nome string, CPF string")
    assert [tuple(r) for r in G.identifier_detect(df2).collect()] == [(2, "CPF")]
    assert G.identifier_pick(df2).first()[0] == "CPF"
    req = {r["column"]: r["present"] for r in G.required_columns(df2).collect()}
    assert req["Idade"] is False


def test_resolve_headers_case_insensitive(spark):
    df = spark.createDataFrame([("1",)], "` idade ` string")
    assert G.resolve_headers(df).columns == ["idade"]


def test_byte_order_mark_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "José"), ("2", None)], "ID string, nome string")
    SC.write_delimited(df.coalesce(1), str(tmp_path / "out"), encoding="UTF-8-SIG")
    raw = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfID,nome")
    assert sorted(map(tuple, SC.read_many(spark, str(tmp_path / "out")).collect())) == [("1", "José"), ("2", None)]
    fmt = SC.probe(spark, str(tmp_path / "out"))
    assert fmt.header == ("ID", "nome") and len(SC.read_delimited(spark, str(tmp_path / "out"), fmt).collect()) == 2
