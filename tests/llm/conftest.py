import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null in every column, empty and blank and very long texts, repeated rows and ids, and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
    rows = [
        (1, "One two three four five six seven.", "en", "a", 34),
        (1, "One two three four five six seven.", "en", "a", 34),
        (1, "Another text under the same id, with some words.", "en", "b", 48),
        (None, "One  two three four five six seven.", None, None, None),
        (None, None, None, None, None),
        (2, None, "en", None, 0),
        (3, "", "en", "a", 0),
        (4, " \t\n", "", "", 3),
        (5, long, "en", "b", len(long)),
        (6, long + " end", "en", "b", len(long) + 4),
        (7, "x" * 700_000, "en", "c", 700_000),
        (8, "Ünïcödé 🙂 naïve — café <|im_end|> mail a.b@c.de, 10.0.0.1 or +1 (614) 555-8001", "fr", "c", 70),
        (9, "short", "en", "c", 5),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    names = "size h k shard slot digest length row_key s n kept score predicted target copies taken found spans items node root base added full cut".split()
    return docs.select("*", *[F.lit(None).cast("string").alias(c) for c in names]).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
