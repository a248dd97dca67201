import pytest

#: Names that operators use inside or give to results.
CLASHING = ["size", "shard", "slot", "score", "rank", "start", "end", "key", "node", "a", "b", "bucket", "id", "digest", "n", "kind", "gram", "route", "piece", "length", "offset", "ids", "route_", "label", "_row", "_b", "_n", "group_key", "root", "total", "count", "first", "last"]


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) with columns of clashing names beside them."""

    def make(rows, extra=True):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *(F.lit(7).alias(c) for c in CLASHING))
        return df

    return make


LONG = "word " * 30_000
ODD = [
    (0, "alpha beta gamma delta epsilon zeta eta theta"),
    (1, None),
    (2, ""),
    (None, "a text without an id, of a few more words than five"),
    (4, "alpha beta gamma delta epsilon zeta eta theta"),
    (4, "alpha beta gamma delta epsilon zeta eta theta"),
    (5, LONG),
    (6, "漢字かな交じり文 \U0001f600 naïve\nline two\n\nline four   spaced"),
    (-7, "x"),
    (8, "\n\n\n"),
    (9, "tab\tand\x00null \x1c sep"),
]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def none(docs):
    return docs([])
