import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "b", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7),
    (4, "Same text here, twice over and over again", "en", "a", 3),
    (4, "Same text here, twice over and over again", "en", "a", 3),
    (5, "Same text here, twice over and over again", None, "a", 3),
    (None, "one", "en", "b", 1),
    (6, "two words", "de", "b", 1),
    (7, LONG, "en", "c", 1),
    (8, LONG + " tail", "en", "c", 1),
    (9, "ÀÉ naïve café   Σίσυφος <|endoftext|> é İ", "fr", None, 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, ties, repeated rows, very long texts."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns with names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "fp", "key", "size", "bucket", "record", "ticket", "shard", "slot", "score", "words", "block", "name", "target", "taken", "component_id", "start", "h"]
    return odd.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
