"""Gates of a landing, shares outside a domain, training sections of reports."""

from cohort import contract as K
from cohort.operators import observe as O
from cohort.operators import reports as RP
from cohort.operators import summary as SU


def test_gates_of_a_landing(spark, tmp_path):
    rows = [(1, "Ana", " ", "30", "xyz"), (2, None, None, None, None), (3, "nan", "", "31", "Ensino médio - 3º ano")]
    sheet = spark.createDataFrame(rows, "row_id long, Nome string, CPF string, Idade string, `Grau de Escolaridade` string").withColumnsRenamed(
        {"Grau de Escolaridade": K.REQUIRED_HEADERS["grau_escolaridade"], "Idade": K.REQUIRED_HEADERS["idade"]})
    folder, gates = O.land_observed(sheet, str(tmp_path), "in")
    assert spark.read.parquet(folder).count() == gates.rows == 3 and gates.empty_rows == 1 and gates.has_data
    assert gates.filled["nome"] == 1 and gates.filled["cpf"] == 0 and gates.filled["idade"] == 2 and gates.identifiers() == ["Nome"]
    assert K.REQUIRED_HEADERS["idade"] not in gates.missing_headers() and K.REQUIRED_HEADERS["remuneracao"] in gates.missing_headers()
    assert gates.unrecognised == {"grau_escolaridade": 1}
    assert ("age", K.REQUIRED_HEADERS["idade"]) not in gates.missing_features(K.FEATURE_NAMES) and len(gates.missing_features(K.FEATURE_NAMES)) > 5


def test_blank_sheet_has_no_data(spark, tmp_path):
    _, gates = O.land_observed(spark.createDataFrame([(1, " ", None), (2, "nan", "")], "row_id long, Nome string, CPF string"), str(tmp_path), "in")
    assert not gates.has_data and gates.identifiers() == [] and gates.empty_rows == 0


def test_values_outside_the_domain(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    got = [tuple(r) for r in SU.fixed_domain_distribution(df, "c", ["a", "b", "x"], other="Outros").orderBy("position").collect()]
    assert got == [(0, "a", 1, 25.0), (1, "b", 1, 25.0), (2, "x", 0, 0.0), (3, "Outros", 2, 50.0)]


def test_training_sections(spark):
    scored = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, classification string")
    training = spark.createDataFrame([("a", "a: 3 pessoas", ["x", "y"])], "label string, training_summary string, training_details array<string>")
    rows = RP.training_block(scored, training, ["m"]).orderBy("row_id", "ordinal").collect()
    assert [r["text"] for r in rows if r["row_id"] == 1] == [K.TRAINING_CONTEXT + "a: 3 pessoas", K.TRAINING_NOTES, "  • x", "  • y", "", K.MODEL_SECTION, "  • m", ""]
    assert [r["text"] for r in rows if r["row_id"] == 2] == [K.MODEL_SECTION, "  • m", ""]
    empty = RP.training_block(scored, training.where("false"), []).where("row_id = 1").collect()
    assert [r["text"] for r in empty] == [K.MODEL_SECTION, "  • " + K.MODEL_UNKNOWN, ""]
