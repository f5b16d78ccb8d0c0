import pytest

SMALL = "/root/testdata/sf0.001"

LINES = "one two three four five six seven.\nAlpha beta gamma delta.\nthe last line of this text is here."
LONG = " ".join(f"w{i % 977}{'.' if i % 11 == 0 else ''}" for i in range(60_000))
ODD = [
    # doc_id, text, lang, source: nulls, empty and blank texts, repeated rows, ties, a very long text
    (1, LINES, "en", "a"), (2, LINES, "en", "a"), (2, LINES, "en", "a"), (3, None, "de", None), (4, "", None, "b"),
    (5, " \t\n \x0b", "fr", "b"), (6, LINES.upper(), "en", "B"), (7, "İi ß 日本語 <|endoftext|> it's", "en", "é"), (8, LONG, "en", "a"),
    (9, LONG + " end", "en", None), (None, LINES, "en", "a"), (None, None, None, None), (10, "12 34 56", "en", "a"),
    (11, "x\r\ny\r\nz\r\nx\r\ny\r\nz", "es", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# Columns that have the name of one the operators make or use.
CLASHING = ["row", "n", "kept", "size", "Taken", "copies", "text_hash", "clean_text", "score", "component_id", "part", "nth"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that jobs stumble over, with further columns of clashing names."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", *(f"'{c}' AS {c}" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
