import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, kept string, shard int, `a.b` int"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like inner ones."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    clean = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
    rows = [
        (1, clean, "en", "src1", 5, "x", 1, "y", 1, 1),
        (2, clean, "en", "src1", 5, None, None, None, None, None),
        (2, clean, "en", "src1", 5, None, None, None, None, None),
        (3, None, "en", "src2", None, "x", 1, "y", 1, 1),
        (4, "", None, None, 0, "x", 1, "y", 1, 1),
        (5, " \t\n\x0b\x0c\r ", "de", "src2", 7, "x", 1, "y", 1, 1),
        (6, long, "en", "src1", 9, "x", 1, "y", 1, 1),
        (7, long + " tail", "en", "src1", 9, "x", 1, "y", 1, 1),
        (None, "alpha beta", None, "src0", None, "x", 1, "y", 1, 1),
        (None, "alpha beta", "fr", "weird source", None, "x", 1, "y", 1, 1),
        (8, "Ünïcödé \U0001f600 wörds here", "fr", "src3", 1, "x", 1, "y", 1, 1),
        (9, "short", "en", "src9", 5, "x", 1, "y", 1, 1),
        (9, "another text of the same id", "en", "src9", 5, "x", 1, "y", 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
