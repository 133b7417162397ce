import pytest
from pyspark.sql import types as T

LONG = "word " * 40_000


@pytest.fixture
def docs(spark):
    """Documents with columns that clash with names that operators use; rows are (doc_id, text)."""

    def make(rows):
        names = ["TEXT", "doc_id", "length", "text", "node", "_uid", "lang"]
        kinds = [T.StringType(), T.LongType(), T.StringType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
        return spark.createDataFrame([("other", i, "x", t, 1, None, "en") for i, t in rows], schema)

    return make


@pytest.fixture
def edge_rows():
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c"), (6, "a b c"), (5, "a b c"), (None, "a b c"),
        (None, None), (7, "x"), (8, "one\ntwo\nthree\nfour"), (9, "one\ntwo\nthree\nfive"), (10, "Ünï 中文 🙂"),
    ]
