import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    long = " ".join(f"w{i % 977} x." for i in range(60_000))
    rows = [
        (None, None, None, None, None), (None, "only text", None, None, 9), (1, "", "en", "a", 0), (2, "  \n\t ", "en", "a", 5), (3, "one", "de", "b", 3), (3, "one", "de", "b", 3),
        (4, "1234 !!", "fr", None, 7), (5, long, "en", "a", len(long)), (6, "same text here for all of it\nand one more line here", "en", "c", 52), (7, "same text here for all of it\nand one more line here", "en", "c", 52),
        (8, "same text here for all of it\nand one more line here", "en", "c", 52), (9, "äöü ﬁ 日本語 😀 \x00 x", "de", "a", 17),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = ("size", "taken", "target", "bucket", "_text", "_id", "_nil", "fingerprint", "component", "score", "lang_pred", "shares", "_lines", "n_lines", "place", "label", "quality", "_h", "shard", "_n", "_copy", "_times", "_of_doc_id", "_0")
    return df.selectExpr("*", *(f"'x' AS {c}" for c in clashing))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
