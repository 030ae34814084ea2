import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n", T.LongType()), T.StructField("bucket", T.StringType()), T.StructField("id", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns whose names clash with those that operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "s", 1, "b", "x") for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    words = [f"w{i * 7919 % 1000}" for i in range(30_000)]
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"), (6, " ".join(words)), (7, " ".join(words[:-3])),
            (8, "né 😀 ▁ token = abcdefghij \x00 x"), (9, "a" * 200), (10, "a" * 200)]
