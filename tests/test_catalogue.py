"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or value != value:
        return None
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return round(value, 6) if isinstance(value, float) else str(value)


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_whole_tables(spark, duck):
    """These queries take all events."""
    data = DATA.replace("0.001", "0.01")
    n, above, users = duck.execute(f"SELECT count(*), count(*) FILTER (WHERE value > 50), count(DISTINCT user_id) FROM '{data}/events.parquet'").fetchone()
    want = {"sum_wrapped": users, "spline_lookup": n, "ingest_table": n, "pending_rows_seen": above}
    got = {name: QUERIES[name](spark, data) for name in want}
    assert {name: df.distinct().count() for name, df in got.items()} == want
    assert got["spline_lookup"].where("page_id is null").isEmpty()
