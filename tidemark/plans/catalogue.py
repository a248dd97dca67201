"""All queries over the driver's tables and their SQL."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions.buckets import BUCKETS_8, BUCKETS_16, BUCKETS_64, in_mask
from ..functions.times import bucket, epoch_seconds
from ..operators import blobs, custom, grouping, ingest, pages, relational, retention, scan, spline
from ..schema import type_of_width
from ..sources import page_file
from ..streaming import ingest as streaming

DAY, WIDE = 86400, 706000
PER_PAGE = 42
#: Ring sizes of the retention queries: data pages, erase block; blob page size, blob header, blob pages.
RING, BLOCK = 60, 4
BLOB_PAGE, BLOB_HEADER, BLOB_RING = 512, 12, 60

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{events}", EVENTS_SQL).replace("{paged}", PAGED_SQL)
        return f

    return add


EVENTS_SQL = "(SELECT event_id, epoch_us(ts) // 1000000 AS k, user_id, event_type, value, CAST(floor(value) AS INTEGER) AS v, props FROM events)"
PAGED_SQL = f"(SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // {PER_PAGE} AS page_id FROM {EVENTS_SQL})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time series: event_id, k (epoch seconds), user_id, event_type, value, v (whole value), props."""
    return table(spark, sf_dir, "events").select("event_id", epoch_seconds("ts").alias("k"), "user_id", "event_type", "value", F.floor("value").cast("int").alias("v"), "props")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_pages(events(spark, sf_dir), "event_id", PER_PAGE)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local one only in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def _key_at(rows: DataFrame, share: float) -> int:
    """The key that about this share of the rows does not exceed."""
    return rows.agg(F.percentile_approx("event_id", share)).first()[0]


# scans and lookups


@query("SELECT event_id, k, v FROM {events}")
def scan_all(spark, sf_dir):
    return scan.table_scan(events(spark, sf_dir), ["event_id", "k", "v"])


@query("SELECT event_id, value FROM {events} WHERE event_id BETWEEN 100 AND 799")
def range_key(spark, sf_dir):
    return scan.range_scan(events(spark, sf_dir), "event_id", 100, 799).select("event_id", "value")


@query("SELECT event_id, value FROM {events} WHERE value BETWEEN 20 AND 60.5")
def range_value(spark, sf_dir):
    return scan.range_scan(events(spark, sf_dir), "event_id", data="value", min_data=20, max_data=60.5).select("event_id", "value")


@query("SELECT event_id, value FROM {events} WHERE event_id >= 250 AND value BETWEEN 23 AND 38")
def range_key_value(spark, sf_dir):
    return scan.range_scan(events(spark, sf_dir), "event_id", 250, None, "value", 23, 38).select("event_id", "value")


@query("SELECT event_id, k, value FROM {events} WHERE event_id = 321")
def get_point(spark, sf_dir):
    return scan.get(events(spark, sf_dir), "event_id", 321).select("event_id", "k", "value")


@query("""SELECT c.key, e.value, CAST(CASE WHEN e.event_id IS NULL THEN -1 ELSE 0 END AS INTEGER) AS status
          FROM (SELECT c_custkey * 9 AS key FROM customer) c LEFT JOIN {events} e ON e.event_id = c.key""")
def get_many_status(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 9).alias("key"))
    return scan.get_many(events(spark, sf_dir).select("event_id", "value"), "event_id", keys, "key")


@query("SELECT event_id, value FROM {events} WHERE value > 50")
def pending_rows_seen(spark, sf_dir):
    """All rows, stored up to the median key and pending above it."""
    rows = events(spark, sf_dir).select("event_id", "value")
    middle = _key_at(rows, 0.5)
    seen = scan.with_pending(rows.where(F.col("event_id") <= middle), rows.where(F.col("event_id") > middle))
    return relational.select(seen, "value", relational.GT, 50)


# projection and selection


@query("SELECT event_id, user_id, value FROM {events}")
def project_cols(spark, sf_dir):
    return relational.project(events(spark, sf_dir), [0, 2, 4])


@query("SELECT value, event_id, value AS value_1 FROM {events}")
def project_again(spark, sf_dir):
    return relational.project(events(spark, sf_dir), ["value", 0, "value"])


def _selection(name: str, number: int, sign: str):
    def run(spark, sf_dir):
        return relational.select(events(spark, sf_dir).select("event_id", "user_id", "v"), 2, number, 40)

    run.__name__ = f"select_{name}"
    query(f"SELECT event_id, user_id, v FROM {{events}} WHERE v {sign} 40")(run)


for _name, _number, _sign in (("gt", relational.GT, ">"), ("lt", relational.LT, "<"), ("gte", relational.GTE, ">="), ("lte", relational.LTE, "<="), ("eq", relational.EQ, "="), ("neq", relational.NEQ, "<>")):
    _selection(_name, _number, _sign)


@query("SELECT event_id, user_id, v FROM {events} WHERE v <= 40 AND user_id >= 100")
def select_and(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "v")
    return relational.select(relational.select(rows, "v", relational.LTE, 40), "user_id", relational.GTE, 100)


@query("SELECT event_id, u FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS u FROM events) WHERE u > 3000000000")
def select_unsigned(spark, sf_dir):
    """Unsigned numbers of four bytes, half of them above the signed ones."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2654435761 % 4294967296).cast(type_of_width(4)).alias("u"))
    return relational.select(rows, "u", relational.GT, 3_000_000_000)


@query("SELECT event_id, s FROM (SELECT event_id, CAST(event_id * 2654435761 % 4294967296 - 2147483648 AS INTEGER) AS s FROM events) WHERE s <= -1000000000")
def select_signed(spark, sf_dir):
    """Signed numbers of four bytes, half of them below zero."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2654435761 % 4294967296 - 2147483648).cast(type_of_width(-4)).alias("s"))
    return relational.select(rows, "s", relational.LTE, -1_000_000_000)


# the benchmark queries


@query("SELECT CAST(k // 86400 AS BIGINT) AS day, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value FROM {events} GROUP BY 1")
def b1_daily_min_max_avg(spark, sf_dir):
    return grouping.group_by(events(spark, sf_dir), {"day": bucket("k", DAY)}, {"min_value": agg.least("value"), "max_value": agg.most("value"), "avg_value": F.round(agg.mean("value"), 6)}, show_keys=True)


@query("SELECT CAST(k // 86400 AS BIGINT) AS day, round(avg(value), 6) AS avg_value, max(value) AS max_value FROM {events} GROUP BY 1 HAVING max(value) > 250")
def b2_daily_having(spark, sf_dir):
    days = grouping.group_by(events(spark, sf_dir), {"day": bucket("k", DAY)}, {"avg_value": F.round(agg.mean("value"), 6), "max_value": agg.most("value")}, show_keys=True)
    return relational.select(days, "max_value", relational.GT, 250)


@query("SELECT count(*) AS n FROM {events} WHERE v > 30 HAVING count(*) > 0")
def b3_count_filtered(spark, sf_dir):
    return grouping.aggregate_all(relational.select(events(spark, sf_dir), "v", relational.GT, 30), {"n": agg.count()})


@query("""SELECT a.event_id, a.v AS v, b.v AS v_r FROM (SELECT event_id + 500 AS event_id, v FROM {events}) a
          JOIN (SELECT event_id, v FROM {events} WHERE event_id >= 500 AND event_id < 4500) b ON a.event_id = b.event_id""")
def b4_join_shifted(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "v")
    later = scan.range_scan(rows, "event_id", 500, 4499)
    return relational.project(relational.key_join(relational.shift_key(rows, "event_id", 500), later, "event_id", "event_id"), ["event_id", "v", "v_r"])


@query("SELECT CAST(k // 706000 AS BIGINT) AS bucket, count(*) AS n FROM {events} WHERE v > 45 GROUP BY 1")
def b5_bucket_count(spark, sf_dir):
    return grouping.group_by(relational.select(events(spark, sf_dir), "v", relational.GT, 45), {"bucket": bucket("k", WIDE)}, {"n": agg.count()}, show_keys=True)


# joins


@query("SELECT e.event_id, e.v, o.o_orderkey, o.o_totalprice FROM {events} e JOIN orders o ON e.event_id = o.o_orderkey")
def join_key(spark, sf_dir):
    return relational.key_join(events(spark, sf_dir).select("event_id", "v"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "event_id", "o_orderkey")


@query("""SELECT e.user_id, e.event_id, l.l_orderkey, l.l_linenumber
          FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) e
          JOIN (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) l
          ON e.user_id = l.l_orderkey AND e.n = l.n""")
def join_zip(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"))
    return relational.key_join(events(spark, sf_dir).select("user_id", "event_id"), lines, "user_id", "l_orderkey", duplicates="zip", left_order="event_id", right_order="place").drop("place")


@query("""SELECT a.h, a.n, b.h AS h_r, b.total FROM (SELECT k - k % 3600 AS h, count(*) AS n FROM {events} GROUP BY 1) a
          JOIN (SELECT (k + 7200) - (k + 7200) % 3600 AS h, CAST(sum(v) AS BIGINT) AS total FROM {events} GROUP BY 1) b ON a.h = b.h""")
def join_rounded(spark, sf_dir):
    rows = events(spark, sf_dir).select("k", "v")
    left = grouping.group_by(relational.round_key(rows, "k", 3600), {"h": F.col("k")}, {"n": agg.count()}, show_keys=True)
    right = grouping.group_by(relational.round_key(relational.shift_key(rows, "k", 7200), "k", 3600), {"h": F.col("k")}, {"total": agg.total("v")}, show_keys=True)
    return relational.key_join(left, right, "h", "h")


# aggregation


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM {events}),
               r AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM m)
          SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(event_id) AS last_id, arg_max(event_type, event_id) AS kind FROM r GROUP BY run""")
def agg_runs(spark, sf_dir):
    rows = events(spark, sf_dir)
    return grouping.group_runs(rows, "event_id", lambda before: before("event_type") == F.col("event_type"), ["event_type"], {"n": agg.count(), "total": agg.total("v"), "last_id": agg.most("event_id"), "kind": agg.last("event_type", "event_id")})


@query("""WITH m AS (SELECT *, CASE WHEN k - lag(k) OVER (ORDER BY event_id) <= 120 THEN 0 ELSE 1 END AS new FROM {events}),
               r AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM m)
          SELECT min(k) AS first_k, max(k) AS last_k, count(*) AS n FROM r GROUP BY run""")
def agg_sessions(spark, sf_dir):
    return grouping.group_runs(events(spark, sf_dir), "event_id", lambda before: F.col("k") - before("k") <= 120, ["k"], {"first_k": agg.least("k"), "last_k": agg.most("k"), "n": agg.count()})


@query("SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high FROM {events}")
def agg_global(spark, sf_dir):
    return grouping.aggregate_all(events(spark, sf_dir), {"n": agg.count(), "total": agg.total("v"), "low": agg.least("v"), "high": agg.most("v")})


@query("SELECT count(*) AS n FROM {events} WHERE v < 0 HAVING count(*) > 0")
def agg_global_empty(spark, sf_dir):
    return grouping.aggregate_all(events(spark, sf_dir).where("v < 0"), {"n": agg.count()})


@query("""SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, arg_max(event_id, event_id) AS last_id
          FROM {events} GROUP BY k // 86400""")
def agg_all_functions(spark, sf_dir):
    functions = {"n": agg.count(), "total": agg.total("v"), "low": agg.least("v"), "high": agg.most("v"), "mean": F.round(agg.mean("v"), 6), "last_id": agg.last("event_id", "event_id")}
    return grouping.group_by(events(spark, sf_dir), {"day": bucket("k", DAY)}, functions)


@query("SELECT CAST(k // 86400 AS BIGINT) AS day, CAST(CAST(sum(v) AS FLOAT) / CAST(count(v) AS FLOAT) AS FLOAT) AS mean FROM {events} GROUP BY 1")
def avg_float32(spark, sf_dir):
    return grouping.group_by(events(spark, sf_dir), {"day": bucket("k", DAY)}, {"mean": agg.mean("v", 4)}, show_keys=True)


@query("SELECT CAST(k // 86400 AS BIGINT) AS day, arg_max(value, event_id) AS last_value, arg_max(event_type, event_id) AS last_type FROM {events} GROUP BY 1")
def agg_last_value(spark, sf_dir):
    return grouping.group_by(events(spark, sf_dir), {"day": bucket("k", DAY)}, {"last_value": agg.last("value", "event_id"), "last_type": agg.last("event_type", "event_id")}, show_keys=True)


@query("""SELECT user_id, CAST((sum(CAST(event_id AS HUGEINT) * 4611686018427387904) + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS total
          FROM {events} GROUP BY 1""")
def sum_wrapped(spark, sf_dir):
    """All rows."""
    rows = events(spark, sf_dir).withColumn("large", F.col("event_id").cast("decimal(10,0)") * F.lit("4611686018427387904").cast("decimal(19,0)"))
    return grouping.group_by(rows, {"user_id": F.col("user_id")}, {"total": agg.total("large", wrap=True)}, show_keys=True)


@query("SELECT user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM {events} GROUP BY 1 HAVING count(*) >= 65 AND sum(v) <> 3000")
def having_selection(spark, sf_dir):
    users = grouping.group_by(events(spark, sf_dir), {"user_id": F.col("user_id")}, {"n": agg.count(), "total": agg.total("v")}, show_keys=True)
    return relational.select(relational.select(users, "n", relational.GTE, 65), "total", relational.NEQ, 3000)


# buckets, pages and pruning

CASE_8 = "CASE WHEN v < 10 THEN 0 WHEN v < 20 THEN 1 WHEN v < 30 THEN 2 WHEN v < 40 THEN 3 WHEN v < 50 THEN 4 WHEN v < 60 THEN 5 WHEN v < 100 THEN 6 ELSE 7 END"


@query(f"SELECT CAST({CASE_8} AS INTEGER) AS bucket, count(*) AS n FROM {{events}} GROUP BY 1")
def bitmap8_hist(spark, sf_dir):
    return events(spark, sf_dir).groupBy(BUCKETS_8.column(F.col("v")).alias("bucket")).agg(agg.count().alias("n"))


@query("SELECT CAST(least(greatest(ceil((v * 10 - 320) / 30.0), 0), 15) AS INTEGER) AS bucket, count(*) AS n FROM {events} GROUP BY 1")
def bitmap16_hist(spark, sf_dir):
    return events(spark, sf_dir).groupBy(BUCKETS_16.column(F.col("v") * 10).alias("bucket")).agg(agg.count().alias("n"))


@query("SELECT CAST(least(greatest(ceil((v * 10 - 320) / 10.0), 0), 63) AS INTEGER) AS bucket, count(*) AS n FROM {events} GROUP BY 1")
def bitmap64_hist(spark, sf_dir):
    return events(spark, sf_dir).groupBy(BUCKETS_64.column(F.col("v") * 10).alias("bucket")).agg(agg.count().alias("n"))


@query(f"SELECT event_id, v FROM {{events}} WHERE {CASE_8} BETWEEN 2 AND 4")
def bitmap_range_members(spark, sf_dir):
    return events(spark, sf_dir).where(in_mask(F.col("v"), BUCKETS_8, BUCKETS_8.mask(25, 45))).select("event_id", "v")


@query("SELECT event_id, v FROM {events} WHERE least(greatest(ceil((v * 10 - 320) / 30.0), 0), 15) BETWEEN 3 AND 8")
def bitmap16_range_members(spark, sf_dir):
    return events(spark, sf_dir).where(in_mask(F.col("v") * 10, BUCKETS_16, BUCKETS_16.mask(400, 550))).select("event_id", "v")


@query("SELECT event_id, v FROM {events} WHERE least(greatest(ceil((v * 10 - 320) / 10.0), 0), 63) BETWEEN 8 AND 63")
def bitmap64_range_members(spark, sf_dir):
    return events(spark, sf_dir).where(in_mask(F.col("v") * 10, BUCKETS_64, BUCKETS_64.mask(400, None))).select("event_id", "v")


@query(f"""SELECT page_id, count(*) AS n_rows, min(event_id) AS min_key, max(event_id) AS max_key, min(v) AS min_data, max(v) AS max_data,
                  CAST(bit_or(CAST(1 AS BIGINT) << ({CASE_8})) AS BIGINT) AS bitmap FROM {{paged}} GROUP BY 1""")
def page_summary(spark, sf_dir):
    return pages.page_summary(paged(spark, sf_dir), "event_id", "v", BUCKETS_8)


@query("SELECT event_id, v FROM {events} WHERE event_id BETWEEN 150 AND 900 AND v BETWEEN 200 AND 300")
def pruned_range(spark, sf_dir):
    summary = pages.page_summary(paged(spark, sf_dir), "event_id", "v", BUCKETS_8)
    return pages.pruned_scan(events(spark, sf_dir), summary, "event_id", "v", 150, 900, 200, 300, BUCKETS_8).select("event_id", "v")


# ingest and retention


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, max(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events)
          WHERE high IS NULL OR user_id > high""")
def ingest_monotone(spark, sf_dir):
    return ingest.accepted(events(spark, sf_dir).select("event_id", "user_id"), "user_id", "event_id")


@query("""SELECT event_id, user_id, CAST(CASE WHEN high IS NULL OR user_id > high THEN 0 ELSE 1 END AS INTEGER) AS put_status
          FROM (SELECT event_id, user_id, max(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events)""")
def ingest_status(spark, sf_dir):
    return ingest.judged(events(spark, sf_dir).select("event_id", "user_id"), "user_id", "event_id")


@query("SELECT event_id, v FROM {events}")
def ingest_table(spark, sf_dir):
    """All rows: flushed up to the median key, then put from the lower quartile on."""
    rows = events(spark, sf_dir).select("event_id", "v")
    quarter, middle = _key_at(rows, 0.25), _key_at(rows, 0.5)
    stored = ingest.Table(spark, scratch(spark, "table"), "event_id", "event_id", rows.schema)
    stored.put(rows.where(F.col("event_id") <= middle))
    stored.flush()
    stored.put(rows.where(F.col("event_id") >= quarter))  # those up to the median come too late
    return stored.rows()


P_SQL = f"((SELECT count(*) FROM events) - 1) // {PER_PAGE}"
LIVE_SQL = f"(SELECT CASE WHEN p <= {RING} THEN 0 ELSE (p - {RING} + {BLOCK} - 1) // {BLOCK} * {BLOCK} END FROM (SELECT {P_SQL} AS p))"
REOPENED_SQL = f"(SELECT CASE WHEN p <= {RING} THEN 0 WHEN p % {RING} = 0 THEN p - {RING} ELSE p - {RING} + {BLOCK} - p % {BLOCK} END FROM (SELECT {P_SQL} AS p))"
LOGGED_SQL = f"(SELECT CASE WHEN p // {BLOCK} * {BLOCK} >= {RING - 2 * BLOCK} THEN p // {BLOCK} * {BLOCK} - {RING - 2 * BLOCK} + {BLOCK} ELSE 0 END FROM (SELECT {P_SQL} AS p))"


def _retained(spark, sf_dir, first):
    rows = paged(spark, sf_dir)
    written = retention.pages_written(rows.count(), PER_PAGE)
    return retention.retained(rows, first(written, RING, BLOCK)).select("page_id", "event_id", "v")


@query(f"SELECT page_id, event_id, v FROM {{paged}} WHERE page_id >= {LIVE_SQL}")
def retention_live(spark, sf_dir):
    return _retained(spark, sf_dir, retention.first_live_page)


@query(f"SELECT page_id, event_id, v FROM {{paged}} WHERE page_id >= {REOPENED_SQL}")
def retention_reopened(spark, sf_dir):
    return _retained(spark, sf_dir, retention.first_reopened_page)


@query(f"SELECT page_id, event_id, v FROM {{paged}} WHERE page_id >= {LOGGED_SQL}")
def retention_rlc(spark, sf_dir):
    return _retained(spark, sf_dir, retention.first_logged_page)


@query("""SELECT event_id, CAST(n AS INTEGER) AS chunk_no, CAST(substr(props, n * 4 + 1, 4) AS BLOB) AS chunk FROM {events}, range(0, 16) t(n) WHERE n * 4 < strlen(props)""")
def blob_chunks(spark, sf_dir):
    return scan.blob_chunks(events(spark, sf_dir), "event_id", "props", 4)


def _blob_rows(spark, sf_dir):
    rows = paged(spark, sf_dir).withColumn("blob", F.when(F.col("event_id") % 3 != 0, F.col("props").cast("binary")))
    return rows.withColumn("n", F.length("blob"))


ROOM = BLOB_PAGE - BLOB_HEADER
PLACED_SQL = f"""WITH RECURSIVE r AS (SELECT event_id, page_id, row_number() OVER (PARTITION BY page_id ORDER BY event_id) AS i,
                     coalesce(CASE WHEN event_id % 3 <> 0 THEN strlen(props) END, -1) AS n FROM {PAGED_SQL}),
               f AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS pg, CAST({BLOB_HEADER} AS BIGINT) AS spot, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM r
                     UNION ALL
                     SELECT page_id, i, event_id, pg1, spot1, pg0, CASE WHEN n >= 0 AND spot1 = {BLOB_HEADER} AND pg1 > pg0 THEN pg1 - 1 ELSE pg1 END
                     FROM (SELECT *, CASE WHEN n < 0 THEN pg0 ELSE pg0 + (spot0 + 4 + n) // {ROOM} END AS pg1, {BLOB_HEADER} + CASE WHEN n < 0 THEN spot0 ELSE (spot0 + 4 + n) % {ROOM} END AS spot1
                           FROM (SELECT r.page_id, r.i, r.event_id, r.n, f.pg + CAST(f.spot > {BLOB_PAGE - 4} AS BIGINT) AS pg0, CASE WHEN f.spot > {BLOB_PAGE - 4} THEN 0 ELSE f.spot - {BLOB_HEADER} END AS spot0
                                 FROM f JOIN r ON r.page_id = f.page_id AND r.i = f.i + 1))),
               u AS (SELECT page_id, CAST(sum(arg) OVER (ORDER BY page_id) - arg AS BIGINT) AS s FROM (SELECT page_id, max_by(pg + CAST(spot > {BLOB_HEADER} AS BIGINT), i) AS arg FROM f GROUP BY 1)),
               p AS (SELECT event_id, page_id, a + s AS first_blob_page, b + s AS last_blob_page FROM f JOIN u USING (page_id) WHERE i > 0)"""
KEPT_SQL = f"""w AS (SELECT max(last_blob_page) AS w FROM p),
               g AS (SELECT CASE WHEN w <= {BLOB_RING} THEN 0 WHEN w % {BLOB_RING} = 0 THEN w - {BLOB_RING} ELSE w - {BLOB_RING} + {BLOCK} - w % {BLOCK} END AS g FROM w),
               k AS (SELECT CASE WHEN (SELECT g FROM g) = 0 THEN (SELECT min(event_id) FROM p) ELSE (SELECT max(event_id) + 1 FROM p, g WHERE first_blob_page <= g AND last_blob_page >= g) END AS k)"""


@query(PLACED_SQL + "SELECT event_id, page_id, first_blob_page, last_blob_page FROM p")
def blob_pages(spark, sf_dir):
    """Where each value lies."""
    return blobs.blob_pages(_blob_rows(spark, sf_dir), "event_id", "n", BLOB_PAGE, BLOB_HEADER)


def _first_kept(rows):
    """The least key whose value a ring of blob pages still has after reopening."""
    placed = blobs.blob_pages(rows, "event_id", "n", BLOB_PAGE, BLOB_HEADER).persist()
    first = blobs.first_kept_key(placed, "event_id", blobs.blob_pages_written(placed), BLOB_RING, BLOCK, reopened=True)
    placed.unpersist()
    return first


@query(PLACED_SQL + ", " + KEPT_SQL + """ SELECT event_id, CAST(has AND event_id < k AS INTEGER) AS blob_status, has AND event_id >= k AS has_blob
          FROM (SELECT event_id, event_id % 3 <> 0 AND props IS NOT NULL AS has FROM events), k""")
def blob_status(spark, sf_dir):
    """Values that a ring of blob pages has lost after reopening."""
    rows = _blob_rows(spark, sf_dir)
    return blobs.with_blob_status(rows, "event_id", "blob", _first_kept(rows)).select("event_id", "blob_status", F.col("blob").isNotNull().alias("has_blob"))


@query(PLACED_SQL + ", " + KEPT_SQL + """ SELECT event_id, value, CASE WHEN event_id >= k THEN blob END AS blob, CAST(blob IS NOT NULL AND event_id < k AS INTEGER) AS blob_status
          FROM (SELECT event_id, value, CASE WHEN event_id % 3 <> 0 THEN props END AS blob FROM events WHERE event_id >= 500), k""")
def range_with_blob(spark, sf_dir):
    """A range of keys with its values, of which the ring has lost some."""
    rows = _blob_rows(spark, sf_dir)
    kept = blobs.with_blob_status(rows, "event_id", "blob", _first_kept(rows))
    return scan.range_scan(kept, "event_id", 500).select("event_id", "value", F.col("blob").cast("string").alias("blob"), "blob_status")


@query(PLACED_SQL + ", " + KEPT_SQL + """ SELECT c.key, e.value, CASE WHEN e.event_id >= k THEN e.blob END AS blob,
          CAST(CASE WHEN e.event_id IS NULL THEN -1 WHEN e.blob IS NOT NULL AND e.event_id < k THEN 1 ELSE 0 END AS INTEGER) AS status
          FROM (SELECT c_custkey * 9 AS key FROM customer) c LEFT JOIN (SELECT event_id, value, CASE WHEN event_id % 3 <> 0 THEN props END AS blob FROM events) e ON e.event_id = c.key, k""")
def get_many_blobs(spark, sf_dir):
    """Lookups with values: found, found without its value, missing."""
    rows = _blob_rows(spark, sf_dir)
    kept = blobs.with_blob_status(rows, "event_id", "blob", _first_kept(rows))
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 9).alias("key"))
    return scan.get_many(kept.select("event_id", "value", "blob", "blob_status"), "event_id", keys, "key", F.col("blob_status") == 1).drop("blob_status").withColumn("blob", F.col("blob").cast("string"))


# the learned index


SPLINE_SQL = f"""WITH RECURSIVE m AS (SELECT page_id AS y, min(event_id) AS x FROM {PAGED_SQL} GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM m),
               f AS (SELECT CAST(2 AS BIGINT) AS i, CAST(a.x AS HUGEINT) AS ox, CAST(a.y AS HUGEINT) AS oy, CAST(b.x AS HUGEINT) AS px, CAST(b.y AS HUGEINT) AS py, CAST(b.x AS HUGEINT) AS lx, CAST(greatest(b.y - 1, 0) AS HUGEINT) AS ly, CAST(b.x AS HUGEINT) AS hx, CAST(b.y + 1 AS HUGEINT) AS hy, false AS new
                     FROM t a, t b WHERE a.i = 1 AND b.i = 2
                     UNION ALL
                     SELECT i, CASE WHEN new THEN px ELSE ox END, CASE WHEN new THEN py ELSE oy END, x, y,
                            CASE WHEN new OR (z - oy) * (lx - ox) > (ly - oy) * (x - ox) THEN x ELSE lx END, CASE WHEN new OR (z - oy) * (lx - ox) > (ly - oy) * (x - ox) THEN z ELSE ly END,
                            CASE WHEN new OR (hy - oy) * (x - ox) > (y + 1 - oy) * (hx - ox) THEN x ELSE hx END, CASE WHEN new OR (hy - oy) * (x - ox) > (y + 1 - oy) * (hx - ox) THEN y + 1 ELSE hy END, new
                     FROM (SELECT f.* EXCLUDE (i, new), t.i, CAST(t.x AS HUGEINT) AS x, CAST(t.y AS HUGEINT) AS y, CAST(greatest(t.y - 1, 0) AS HUGEINT) AS z,
                                  (t.y - oy) * (hx - ox) > (hy - oy) * (t.x - ox) OR (ly - oy) * (t.x - ox) > (t.y - oy) * (lx - ox) AS new FROM f JOIN t ON t.i = f.i + 1)),
               p AS (SELECT x, y FROM t WHERE i = 1 UNION ALL SELECT ox, oy FROM f WHERE new UNION ALL SELECT x, y FROM t WHERE i > 1 AND i = (SELECT max(i) FROM t))
          SELECT row_number() OVER (ORDER BY x) - 1 AS point_no, CAST(x AS BIGINT) AS key, CAST(y AS BIGINT) AS page_id FROM p"""


@query(SPLINE_SQL)
def spline_points(spark, sf_dir):
    """Points of the index."""
    summary = pages.page_summary(paged(spark, sf_dir), "event_id", "v")
    return spline.spline_points(spline.build(summary), spark)


@query("SELECT event_id AS key, page_id FROM {paged}")
def spline_lookup(spark, sf_dir):
    """All keys."""
    rows = paged(spark, sf_dir)
    summary = pages.page_summary(rows, "event_id", "v")
    keys = rows.select(F.col("event_id").alias("key"))
    return spline.page_of(keys, "key", summary, spline.build(summary)).select("key", "page_id")


# operators and aggregates that users bring


@query("SELECT event_id + 1000 AS event_id, v FROM {events}")
def custom_operator_shift(spark, sf_dir):
    return custom.apply_operator(events(spark, sf_dir).select("event_id", "v"), relational.shift_key, "event_id", 1000)


@query("SELECT event_id, CAST(v * 2 AS BIGINT) AS doubled FROM {events} WHERE v > 20")
def custom_operator_rows(spark, sf_dir):
    def step(batches):
        for b in batches:
            some = b[b["v"] > 20]
            yield pd.DataFrame({"event_id": some["event_id"], "doubled": some["v"].astype(np.int64) * 2})

    return custom.apply_rows(events(spark, sf_dir).select("event_id", "v"), step, "event_id long, doubled long")


@query("SELECT user_id, max(v) - min(v) AS spread FROM (SELECT user_id, CAST(v AS BIGINT) AS v FROM {events}) GROUP BY 1")
def custom_aggregate(spark, sf_dir):
    spread = custom.aggregate_with(lambda: None, lambda s, v: (v, v) if s is None else (min(s[0], v), max(s[1], v)), lambda s: int(s[1] - s[0]), "long", F.col("v").cast("long"))
    return events(spark, sf_dir).groupBy("user_id").agg(spread.alias("spread"))


@query("""WITH m AS (SELECT *, CASE WHEN user_id > lag(user_id) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM {events}),
               r AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM m)
          SELECT min(event_id) AS first_id, count(*) AS n FROM r GROUP BY run""")
def custom_predicate_runs(spark, sf_dir):
    return custom.runs_with(events(spark, sf_dir), "event_id", lambda before: F.col("user_id") > before("user_id"), ["user_id"], {"first_id": agg.least("event_id"), "n": agg.count()})


# page files and streams


@query("SELECT event_id AS key, v AS a, CAST(user_id AS INTEGER) AS b, CAST(-v AS INTEGER) AS c FROM {events}")
def page_file_roundtrip(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("v").alias("a"), F.col("user_id").cast("int").alias("b"), (-F.col("v")).alias("c"))
    path = scratch(spark, "pages")
    page_file.write_pages(rows, path)
    return page_file.read_packed(spark, path)


@query(ORACLE_SQL["ingest_monotone"])
def stream_monotone(spark, sf_dir):
    source, out = scratch(spark, "source"), scratch(spark, "stream")
    rows = events(spark, sf_dir).select("event_id", "user_id")
    rows.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    streaming.guarded_append(stream, out, "user_id", "event_id", scratch(spark, "mark")).awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(out).select("event_id", "user_id")


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP))) // 1000000 AS window_start, count(*) AS n, max(value) AS high FROM events GROUP BY 1")
def windows_tumbling(spark, sf_dir):
    windows = streaming.tumbling(table(spark, sf_dir, "events"), "ts", "6 hours", {"n": agg.count(), "high": agg.most("value")})
    return windows.withColumn("window_start", epoch_seconds("window_start"))


@query("""WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events),
               r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM m)
          SELECT user_id, epoch_us(min(ts)) // 1000000 AS session_start, (epoch_us(max(ts)) + 7200000000) // 1000000 AS session_end, count(*) AS n FROM r GROUP BY user_id, run""")
def windows_session(spark, sf_dir):
    sessions = streaming.session_windows(table(spark, sf_dir, "events"), "ts", "2 hours", {"n": agg.count()}, ("user_id",))
    return sessions.withColumn("session_start", epoch_seconds("session_start")).withColumn("session_end", epoch_seconds("session_end"))
