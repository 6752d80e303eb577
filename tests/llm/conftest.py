import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Columns of documents, and more whose names are those of results.
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("score", StringType()), StructField("node", StringType()), StructField("size", LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", "y", 1) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd white space."""
    r = random.Random(5)
    words = ["the", "thonre", "erh", "and", "ßber", "été", "中文", "x1", "don't", "over"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    long = text(6000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "...!!", None, "b"), (None, text(30), "fr", "b"),
        (6, long, "en", "a"), (7, "word", "en", None), (8, "word", "en", None), (9, text(40), "de", "c"), (9, text(40), "de", "c"),
        (10, "same text here for all of us today", "en", "a"), (10, "same text here for all of us today", "en", "a"),
        (11, "  lead  two　wide gap <|endoftext|> end\x0b\x1c. A,b ", "en", "b"), (12, "x" * 3000, "en", "c"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
