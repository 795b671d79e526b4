import pytest

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a
    long text, and columns named like the operators' own."""
    long_text = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    rows = [(1, "a b c d e f", "en", "s", 11, "u"), (1, "a b c d e f", "en", "s", 11, "u"),
            (2, "", "en", "s", 0, None), (3, None, None, None, None, None), (None, "a b c d e f", "en", "s", 11, "v"),
            (4, " \t\n", "en", "s", 3, "w"), (5, long_text, "en", "t", len(long_text), "x"), (6, "A B  c d e F", "de", "t", 12, "y"),
            (None, None, None, None, None, None), (7, "one", "fr", None, 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
