import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, length bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    body = "One two three four five six seven eight nine ten. "
    rows = [
        (1, body * 3, "en", "a", 1, "x", 9),
        (2, (body * 3).upper(), "en", "a", 1, "x", 9),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", 0),
        (5, body * 4000, "en", "b", 0, "", 0),
        (6, "a" * 50_000 + " " + "é" * 3000, "fr", "b", 0, "", 0),
        (7, "Übermut <|endoftext|> tut\tselten gut \U0001f600\n\n  x", "de", "b", 0, "", 0),
        (7, "Übermut <|endoftext|> tut\tselten gut \U0001f600\n\n  x", "de", "b", 0, "", 0),
        (None, "no id at all", "en", "c", 3, "", 0),
        (None, "no id at all", "en", "c", 3, "", 0),
        (8, "\n \t ", "en", "c", 3, "", 0),
    ] + [(100 + k, body * (k % 7 + 1) + f"row {k}", "en", "hot", 5, "", 1) for k in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
