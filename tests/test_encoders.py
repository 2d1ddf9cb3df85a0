"""Rule tables: (cell, expected) pairs for every encoder, literal reading of the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohort.functions import cells as C
from cohort.functions import encode as E
from cohort.functions import text as T

NBSP = " "


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_normalize_text(spark):
    vals = [None, "", "  Educação Infantil ", "ÁÀÃÂÉÊÍÓÔÕÚÜÇ", f"{NBSP}Médio{NBSP}"]
    assert run(spark, T.normalize_text, vals) == ["", "", "educacao infantil", "aaaaeeiooouuc", "medio"]


def test_collapse_ws(spark):
    vals = ["União  Estável", f" solteira{NBSP}", None, "a\t\n b"]
    assert run(spark, T.collapse_ws, vals) == ["união estável", "solteira", None, "a b"]


def test_age(spark):
    vals = ["25", " 30 ", "25 anos", "trinta", None, "", "12d", "1e2", "-3", ".5"]
    assert run(spark, E.coerce_number, vals) == [25.0, 30.0, 0.0, 0.0, 0.0, 0.0, 0.0, 100.0, -3.0, 0.5]


@pytest.mark.parametrize("cell,expected", [
    ("Sem escolaridade - Não alfabetizado", 0), ("Educação infantil", 0),
    ("Ensino fundamental - 5º ano", 1), ("Ensino Fundamental - 2º ano", 1), ("Ensino médio - 3º ano", 2),
    ("ENSINO MÉDIO", 2), ("Ensino superior - Graduação", 3), ("Pós-Graduação", 3), ("Curso técnico", 1),
    ("Educação de Jovens e Adultos (EJA) - Ensino fundamental (EJA)", 1), ("desconhecido", 0),
    ("", 0), (None, 0), ("   ", 0), ("sem escolaridade - ensino tecnico", 1), ("Ensino médio - 1° ano", 2),
])
def test_education(spark, cell, expected):
    assert run(spark, E.encode_education, [cell]) == [expected]


@pytest.mark.parametrize("cell,expected", [
    ("Sim - R$ 600,00", 1), ("SIM", 1), ("Não", 0), ("nao", 0), ("1", 1), ("0", 0), ("true", 1),
    (" Sim  -  R$ 300,00 ", 1), ("talvez", 0), ("", 0), (None, 0), ("s", 1), ("N", 0), ("yes", 1),
    ("verdadeiro", 1), ("simples", 1), ("não sei", 0), (f"sim{NBSP}-{NBSP}r$ 600,00", 1),
])
def test_parse_binary(spark, cell, expected):
    assert run(spark, E.parse_binary, [cell]) == [expected]


@pytest.mark.parametrize("cell,expected", [
    ("R$ 1.234,56", 1234.56), ("1200", 1200.0), ("a combinar", 0.0), (None, 0.0), ("", 0.0),
    ("1500.50", 150050.0), ("r$ 300,00", 300.0), ("R$", 0.0), ("  R$  99,9 ", 99.9),
])
def test_parse_money(spark, cell, expected):
    assert run(spark, E.parse_money, [cell]) == [pytest.approx(expected)]


def test_marital(spark):
    vals = ["Solteiro(a)", " solteira ", "CASADO", "União  Estável", "uniao estavel", "Divorciado(a)", None, ""]
    single = run(spark, E.marital_single, vals)
    married = run(spark, E.marital_married, vals)
    assert single == [1, 1, 0, 0, 0, 0, 0, 0]
    assert married == [0, 0, 1, 1, 1, 0, 0, 0]


def test_studying_employment_substance(spark):
    assert run(spark, E.studying_flag, ["Cursando", " CURSANDO ", "Concluído", None, "cursando agora"]) == \
        [1, 1, 0, 0, 0]
    assert run(spark, E.employment_signal,
               ["Desempregado(a)", "Empregado com carteira de trabalho assinada", "Autônomo", "bico",
                "Não informado", "Aposentado", None, " CLT "]) == [0.0, 1.0, 0.6, 0.6, 0.0, 0.0, 0.0, 1.0]
    # null counts as use (literal rule), blank and 'não possui' do not
    assert run(spark, E.substance_flag, ["Não possui", "NÃO POSSUI", "", None, "não", "Nunca", "Álcool"]) == \
        [0, 0, 0, 1, 1, 1, 1]


def test_program_duration(spark):
    as_of = dt.date(2001, 8, 1)
    vals = ["01/08/2001", "1/7/2001", "31/02/2000", "2001-01-05", None, "5/3/1999", "01/09/2001"]
    got = run(spark, lambda c: E.program_duration(c, as_of), vals)
    assert got == [0.0, 1.0, 0.0, 0.0, 0.0, round(880 / 30, 1), -1.0]


def test_report_cells(spark):
    assert run(spark, lambda c: C.mask_identifier("CPF", c), ["123.456.789-01", "12345", None, "nan"]) == \
        ["CPF: 123.***.***-01", "CPF: 12345", "", ""]
    assert run(spark, C.format_currency, ["R$ 1.234,5", "1500", "abc", None]) == \
        ["R$ 1.234,50", "R$ 1.500,00", "abc", ""]
    assert run(spark, C.yes_no, ["Sim", "não", "NAO", "talvez", None]) == \
        ["Sim", "Não", "Não", "talvez", "Não informado"]
    assert run(spark, C.format_confidence, ["0.95", "87,5 %", "x", None]) == \
        ["95.0%", "87.5%", "x", "Não informado"]
    flags = run(spark, lambda c: C.dependency_info(c).getField("flag"),
                ["Não possui", "Sim, álcool", "ausente", "sem uso", "Álcool", None])
    assert flags == [False, True, False, False, True, False]


def test_fixed_half_even(spark):
    vals = ["0.125", "2.675", "40.5", "1.005"]
    got = run(spark, lambda c: T.fixed(c.cast("double"), 2), vals)
    assert got == [f"{float(v):.2f}" for v in vals]


def test_fixed_matches_python_on_many_values(spark):
    import random
    rnd = random.Random(7)
    vals = [round(rnd.uniform(-50, 50), rnd.choice([2, 3, 4])) for _ in range(2000)]
    vals += [x / 8 for x in range(-40, 40)] + [0.125, 2.675, 1.005, 40.5, 0.5, 1.5, 2.5]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, v double")
    for d in (0, 1, 2, 3):
        got = [r[0] for r in df.orderBy("i").select(T.fixed(F.col("v"), d)).collect()]
        want = [f"{v:.{d}f}" for v in vals]
        bad = [(v, g, w) for v, g, w in zip(vals, got, want) if g != w]
        assert not bad, bad[:5]
