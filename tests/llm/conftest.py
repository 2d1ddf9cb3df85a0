import pytest

EDGE = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "b"), (4, "one two three", "fr", "a"), (4, "one two three", "fr", "a"),
    (5, "A b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "en", "a"), (6, "a b C d e f g h i j k l m n o p q r s t u v w x y z " * 3, "en", "c"),
    (None, "no id here, yet some words that make a text", "de", "b"), (7, "word " * 30_000, "de", "b"), (8, "émile été ñandú über straße \U0001F600 你好", "es", None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    rows = [(*r, 1, "x", 2.0) for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, key string, size double")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
