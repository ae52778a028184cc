import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
#: Nulls in any column, empty and long texts, ties, repeated rows, and columns named like those of the operators.
ROWS = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 0.5, "k"),
    (3, " \t\n", "en", "b", 3, 0.5, "k"),
    (None, "a row without an id and some words in it", "en", "a", 1, 0.1, "k"),
    (4, "the same text twice over here", "en", "c", 5, 0.2, "x"),
    (5, "the same text twice over here", "en", None, 5, 0.2, "x"),
    (6, "repeated row", "en", "a", 5, 0.2, "x"),
    (6, "repeated row", "en", "a", 5, 0.2, "x"),
    (7, "word " * 60_000, "en", "c", 5, 0.2, "x"),
    (8, "Ünïcode 漢字 😀 words\x00with odd　spaces", "de", "é", 5, 0.2, "x"),
    (9, "x" * 100_000, "en", "b", 5, 0.2, "x"),
    (10, "one", "en", "b", 5, 0.2, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
