from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with further columns whose names clash with those the operators use inside."""

    def documents(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        for name in ("words", "size", "hash", "node", "key", "unit", "place", "spans", "kept", "lettered", "source_size", "copies"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return documents


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


#: Nulls everywhere, an empty and a blank text, a long one, equal rows, ties, non-ASCII, one letterless text.
EDGE = [
    (1, "The cat sat on the mat and the dog ran to the park", "en", "b", 50),
    (1, "The cat sat on the mat and the dog ran to the park", "en", "b", 50),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", None, "a", 4),
    (None, "nobody knows the id of this text", "en", None, None),
    (5, "word " * 30_000, "en", "a", 150_000),
    (6, "12345 !!! ###", "fr", "c", 13),
    (7, "Été à l’œuvre — naïve Straße 東京 😀", "fr", "c", 35),
    (8, "x", None, None, 1),
]
