import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, score int, block int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (5, "The cat sat on the mat and looked at the dog.", "en", "a"),
        (5, "The cat sat on the mat and looked at the dog.", "en", "a"),
        (1, None, "en", "a"),
        (2, "", None, None),
        (None, "A text without an id that is not like any other text here.", "en", "b"),
        (3, "12345 !!! ???", "fr", "b"),
        (4, long, "en", "a"),
        (7, "naïve café — “quotes” 漢字\nsecond line\n\nthird  line", "fr", ""),
        (6, "   \n\t ", "en", "b"),
        (8, "x", "en", "b"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "r", "h", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
