"""Operators against known literals and small models."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import TableConfig
from tidemark.functions import aggregates as agg
from tidemark.functions.buckets import BUCKETS_8, BUCKETS_16, BUCKETS_64
from tidemark.operators import blobs, custom, grouping, ingest, pages, relational, retention, scan, spline
from tidemark.operators.ordered import Ordered
from tidemark.schema import offset_of, resolved, schema_of, width_of
from tidemark.sources import page_file, page_source
from tidemark.streaming.ingest import guarded_append, session_windows, tumbling

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# configuration and schema


def test_geometry():
    assert TableConfig("k").header_size == 6
    assert TableConfig("k").records_per_page == 63
    assert TableConfig("k", widths=(-8,)).records_per_page == 42
    assert TableConfig("k", index_pages=8, bitmap_bytes=1).index_entries_per_page == 496


@pytest.mark.parametrize(
    ("field", "bad", "good", "block"),
    [("data_pages", (407, 409), 408, 4), ("index_pages", (16, 14), 15, 3), ("var_pages", (33, 31), 32, 4)],
)
def test_configuration_checks(field, bad, good, block):
    base = {"erase_pages": block, "data_pages": 60, "bitmap_bytes": 1}
    for n in bad:
        with pytest.raises(ValueError, match="erase block"):
            TableConfig("k", **{**base, field: n}).validated()
    assert TableConfig("k", **{**base, field: good}).validated()


def test_buffers_needed():
    assert TableConfig("k", buffer_pages=2).problems() == []
    assert TableConfig("k", buffer_pages=3, index_pages=8, bitmap_bytes=1).problems()
    assert TableConfig("k", buffer_pages=5, index_pages=8, bitmap_bytes=1, var_pages=8).problems()


def test_schema(frame):
    schema = schema_of(["k", "a", "b"], [4, -4, 8])
    assert [f.dataType.simpleString() for f in schema.fields] == ["bigint", "int", "decimal(20,0)"]
    assert width_of(schema) == 16 and offset_of(schema, 2) == 8
    with pytest.raises(ValueError):
        schema_of(["k"], [0])
    df = frame([(1, 2)], "x int, y int")
    assert resolved(df, 1) == "y" and resolved(df, "x") == "x"
    with pytest.raises(ValueError):
        resolved(df, 2)


# scans


def test_ranges(spark):
    seq = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 100).alias("data"))
    assert scan.range_scan(seq, "key", 32, None, "data", 23, 38).count() == 151
    lin = spark.range(1, 49).select(F.col("id").alias("key"), (F.col("id") * 5 + 106).alias("data"))
    got = pairs(scan.range_scan(lin, "key", min_data=227, max_data=310).select("key"))
    assert got == [(k,) for k in range(25, 41)]
    assert scan.range_scan(lin, "key", 1, 36).count() == 36
    floats = spark.range(72).select((F.col("id") * 3 + 2024).alias("key"), (F.col("id") * 5.18 - 15.24).cast("float").alias("data"))
    assert scan.range_scan(floats, "key").count() == 72


def test_scan_needs_a_key(frame):
    with pytest.raises(ValueError):
        scan.table_scan(frame([(1,)], "k int"))
    with pytest.raises(ValueError):
        scan.table_scan(frame([("a", 1)], "k string, v int"))


def test_lookups(spark, frame):
    table = spark.range(100, 155).select(F.col("id").alias("key"), (F.col("id") - 100).alias("data"))
    keys = frame([(99,), (100,), (154,), (155,)], "want long")
    assert pairs(scan.get_many(table, "key", keys, "want").select("want", "status")) == [(99, -1), (100, 0), (154, 0), (155, -1)]
    assert scan.get_many(table, "key", keys, "want", F.col("key") < 120).where("status = 1").count() == 1
    assert scan.get(table, "key", 99).count() == 0 and scan.get(table, "key", 100).count() == 1
    assert scan.get(table.where("false"), "key", 1).count() == 0


def test_blob_chunks(frame):
    rows = frame([(1, bytearray(b"Testing 001....")), (2, None), (3, bytearray(b""))], "k int, b binary")
    got = scan.blob_chunks(rows, "k", "b", 4).orderBy("k", "chunk_no").collect()
    assert [(r.k, r.chunk_no) for r in got] == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert b"".join(bytes(r.chunk) for r in got) == b"Testing 001...."


# selection, projection, joins


def test_unknown_comparison(spark):
    assert relational.select(spark.range(5).withColumn("v", F.col("id")), "v", 9, 1).count() == 0


def test_projection_orders_and_repeats(frame):
    df = frame([(1, 2, 3)], "a int, b int, c int")
    assert relational.project(df, [2, 0, 2]).collect()[0].asDict() == {"c": 3, "a": 1, "c_1": 3}


@FEW
@given(st.lists(st.integers(0, 4), max_size=8), st.lists(st.integers(0, 4), max_size=8))
def test_zip_join(spark, left, right):
    a = spark.createDataFrame([(k, i) for i, k in enumerate(left)], "k long, o long")
    b = spark.createDataFrame([(k, i) for i, k in enumerate(right)], "k long, o long")
    got = pairs(relational.key_join(a, b, "k", "k", duplicates="zip", left_order="o", right_order="o"))
    want = []
    for key in set(left) & set(right):
        want += [(key, x, key, y) for x, y in zip([i for i, k in enumerate(left) if k == key], [i for i, k in enumerate(right) if k == key])]
    assert got == sorted(want)


# order, runs, ingest


@FEW
@given(st.lists(st.integers(-5, 5), max_size=40), st.integers(1, 9))
def test_order_over_blocks(spark, values, per_block):
    df = spark.createDataFrame([(i * 10, v) for i, v in enumerate(values)], "k long, v long").repartition(3)
    o = Ordered(df, "k", (), per_block)
    assert pairs(o.position("p").select("k", "p")) == [(i * 10, i) for i in range(len(values))]
    assert pairs(o.previous({"v": "w"}).select("k", "w")) == [(i * 10, values[i - 1] if i else None) for i in range(len(values))]
    assert pairs(o.highest_before("v", "h").select("k", "h")) == [(i * 10, max(values[:i]) if i else None) for i in range(len(values))]
    assert pairs(o.running_sum("v", "s").select("k", "s")) == [(i * 10, sum(values[: i + 1])) for i in range(len(values))]


@FEW
@given(st.lists(st.integers(1, 3), max_size=30), st.integers(1, 9))
def test_runs(spark, values, per_block):
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long")
    got = grouping.group_runs(df, "k", lambda before: before("v") == F.col("v"), ["v"], {"v": agg.last("v", "k"), "n": agg.count(), "first": agg.least("k")}, (), per_block)
    want, at = [], 0
    for v, g in itertools.groupby(values):
        n = len(list(g))
        want.append((v, n, at))
        at += n
    assert pairs(got) == sorted(want)


@FEW
@given(st.lists(st.integers(0, 60), unique=True, max_size=30))
def test_sessions(spark, keys):
    keys = sorted(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = pairs(grouping.sessions(df, "k", 3, {"a": agg.least("k"), "b": agg.most("k")}, 5))
    want = []
    for k in keys:
        if want and k - want[-1][1] <= 3:
            want[-1] = (want[-1][0], k)
        else:
            want.append((k, k))
    assert got == want


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(0, 50)), max_size=40), st.integers(1, 9), st.one_of(st.none(), st.integers(0, 20)))
def test_rising_keys(spark, keys, per_block, bar):
    df = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    want, high = [], bar
    for i, k in enumerate(keys):
        if k is not None and (high is None or k > high):
            want.append((i, k))
            high = k
    assert pairs(ingest.accepted(df, "k", "i", bar, per_block)) == want


def test_table_reopens_and_rejects(spark, tmp_path):
    schema = spark.range(0).select(F.col("id").alias("key"), F.col("id").alias("data")).schema
    table = ingest.Table(spark, str(tmp_path / "t"), "key", "key", schema)
    assert table.rows().count() == 0
    table.put(spark.range(1, 1976).select(F.col("id").alias("key"), F.col("id").alias("data")))
    assert table.stored().count() == 0 and table.rows().count() == 1975  # seen before any flush
    table.flush()
    table.flush()
    again = ingest.Table(spark, str(tmp_path / "t"), "key", "key", schema)
    one = spark.createDataFrame([(1974, 0)], schema)
    assert [r.put_status for r in again.put(one).collect()] == [1]
    again.flush()
    assert again.rows().count() == 1975 and again.stats()["max_key"] == 1975
    again.reset()
    assert again.rows().count() == 0


def test_empty_aggregates(spark):
    none = spark.range(0)
    assert grouping.aggregate_all(none, {"n": agg.count()}).count() == 0
    assert grouping.group_by(none, {"k": F.col("id")}, {"n": agg.count()}).count() == 0
    assert grouping.group_runs(none, "id", lambda before: F.lit(True), [], {"n": agg.count()}).count() == 0


def test_wrapping_sum(frame):
    df = frame([(2**63 - 1,), (2,)], "v long")
    assert df.agg(agg.total("v", wrap=True).alias("s")).first().s == -(2**63) + 1


def test_small_average(frame):
    df = frame([(16777217,), (1,), (1,)], "v long")
    assert df.agg(agg.mean("v", 3).alias("m")).first().m == pytest.approx(float(np.float32(16777219) / np.float32(3)))
    assert agg.mean("v", 8) is not None


# buckets and pages


def test_buckets_agree(spark):
    for buckets in (BUCKETS_8, BUCKETS_16, BUCKETS_64):
        values = list(range(-50, 1100, 3)) + [310, 320, 321, 330, 350, 351, 940, 950]
        df = spark.createDataFrame([(v,) for v in values], "v long").select("v", buckets.column(F.col("v")).alias("b"), buckets.bit(F.col("v")).alias("bit"))
        for r in df.collect():
            assert r.b == buckets.number(r.v)
            assert r.bit % (1 << 64) == 1 << r.b
    assert BUCKETS_8.mask() == 255 and BUCKETS_64.mask() == -1
    assert [BUCKETS_16.number(v) for v in (320, 321, 350, 351, 9999)] == [0, 1, 1, 2, 15]


@FEW
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(0, 1000), st.integers(0, 400))
def test_pruning_drops_nothing(spark, values, low, width):
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long")
    paged = pages.with_pages(df, "k", 5, rows_per_block=7)
    for buckets in (BUCKETS_8, BUCKETS_16, BUCKETS_64):
        got = pages.pruned_scan(paged, pages.page_summary(paged, "k", "v", buckets), "k", "v", 3, 40, low, low + width, buckets)
        assert pairs(got.select("k", "v")) == [(k, v) for k, v in enumerate(values) if 3 <= k <= 40 and low <= v <= low + width]


# retention and blobs


@pytest.mark.parametrize(
    ("rows", "flushed", "written", "first", "free"),
    [(0, False, 0, 0, 92), (1135, False, 27, 0, 65), (3865, False, 92, 0, 0), (3907, False, 93, 4, 3), (17473, False, 416, 328, 4), (7560, True, 180, 92, 4), (7728, True, 184, 92, 0)],
)
def test_reopened_retention(rows, flushed, written, first, free):
    assert retention.pages_written(rows, 42, flushed) == written
    assert retention.first_reopened_page(written, 92, 4) == first
    assert retention.free_pages(first, written, 92, 4) == free


def test_reopened_first_key():
    assert retention.first_reopened_page(retention.pages_written(13758, 42, True), 92, 4) * 42 + 1 == 10081


def test_record_level_retention():
    assert retention.free_pages(0, 0, 32, 4, True) == 24
    assert retention.first_logged_page(24, 32, 4) == 4
    assert retention.free_pages(4, 24, 32, 4, True) == 4
    assert retention.free_pages(0, retention.pages_written(1008, 42), 32, 4, True) == 1


@pytest.mark.parametrize(("rows", "pages_n", "least", "first"), [(31312, 1, 0, 3), (125056, 4, 0, 0), (343792, 11, 7, 0)])
def test_index_retention(rows, pages_n, least, first):
    data_pages = retention.pages_written(rows, 63)
    written = data_pages // 496
    assert written == pages_n
    assert retention.first_reopened_page(written, 4, 2) in (least, least + 1)


@pytest.mark.parametrize(
    ("rows", "flushed", "start", "written", "kept"),
    [(43, False, 100, 2, 101), (337, False, 1648, 16, 1649), (2227, False, 100, 106, 803), (5187, True, 6798, 247, 10441), (1429, False, 1444, 68, None)],
)
def test_blob_expiry(spark, rows, flushed, start, written, kept):
    df = spark.range(start + 1, start + rows + 1).select(F.col("id").alias("key"), F.lit(13).alias("n"))
    paged = pages.with_pages(df, "key", 42)
    placed = blobs.blob_pages(paged, "key", "n", 512, 8, pages_per_task=7).persist()
    assert blobs.blob_pages_written(placed, flushed) == written
    if kept:
        assert blobs.first_kept_key(placed, "key", written, 76, 4, reopened=True) == kept
    if rows == 2227:
        assert blobs.first_kept_key(placed, "key", written, 76, 4, reopened=False) == 773
    placed.unpersist()


@FEW
@given(st.lists(st.integers(-1, 90), min_size=1, max_size=60))
def test_blob_layout(lengths):
    """Against single bytes laid one after the other."""
    size, head = 64, 8
    spots, page, at = [], 0, head
    for n in lengths:
        if at > size - 4:
            page, at = page + 1, head
        if n < 0:
            spots.append((page, page))
            continue
        touched = []
        for _ in range(n + 4):
            touched.append(page)
            at += 1
            if at == size:
                page, at = page + 1, head
        spots.append((touched[0], touched[-1]))
    assert blobs.layout(lengths, size, head) == spots


def test_blob_status(frame):
    df = frame([(1, bytearray(b"x")), (2, None), (5, bytearray(b"y"))], "k int, b binary")
    assert [(r.k, r.blob_status, r.b is not None) for r in blobs.with_blob_status(df, "k", "b", 3).orderBy("k").collect()] == [(1, 1, False), (2, 0, False), (5, 0, True)]


# the learned index


def test_spline_points():
    index, key, rows = spline.Spline(1, 4, 1), 97855, []

    def put(count, step):
        nonlocal key
        for _ in range(count):
            rows.append(key)
            key += step
            if len(rows) % 42 == 1 and len(rows) > 1:
                page = len(rows) // 42 - 1
                index.add(rows[page * 42], page)

    put(80, 1)
    assert index.points == [(97855, 0)]
    put(170, 15)
    assert index.points == [(97855, 0), (97995, 2), (99255, 4)]
    put(171, 2)
    assert index.points == [(97855, 0), (97995, 2), (100573, 7), (100741, 9)]
    put(170, 45)
    assert index.points == [(97995, 2), (100573, 7), (100825, 10), (106452, 13)]
    put(300, 128)
    assert index.points == [(100573, 7), (100825, 10), (108342, 14), (140349, 20)]


def test_spline_pruned_as_pages_go():
    index, key, rows, seen = spline.Spline(1, 4, 1), 27693354, [], []
    for count, step in ((300, 1), (400, 50), (1000, 10)):
        for _ in range(count):
            rows.append(key)
            key += step
            if len(rows) % 42 == 1 and len(rows) > 1:
                page = len(rows) // 42 - 1
                index.prune(retention.first_logged_page(page + 1, 32, 4))
                index.add(rows[page * 42], page)
        seen.append(len(index.points))
    assert seen == [2, 3, 2]


@FEW
@given(st.lists(st.integers(1, 500), min_size=2, max_size=200), st.integers(1, 8))
def test_spline_finds(steps, error):
    keys = np.cumsum(steps).tolist()
    index = spline.Spline(error)
    for page, k in enumerate(keys):
        index.add(k, page)
    for page, k in enumerate(keys):
        _, low, high = index.find(k)
        assert low - 1 <= page <= high + 1
    index.prune(len(keys) // 2)
    assert len(index.points) >= 2
    assert not index.erase(len(index.points) - 1) and not index.erase(len(index.points) + 1)


def test_page_lookup(spark):
    rng = np.random.default_rng(3)
    keys = np.cumsum(rng.integers(1, 400, 2000)).tolist()
    paged = pages.with_pages(spark.createDataFrame([(k, 1) for k in keys], "key long, v int"), "key", 42)
    summary = pages.page_summary(paged, "key", "v")
    index = spline.build(summary)
    asked = spark.createDataFrame([(k,) for k in keys[::17]] + [(0,), (keys[-1] + 5,)], "key long")
    got = dict(pairs(spline.page_of(asked, "key", summary, index).select("key", "page_id")))
    assert all(got[k] == i // 42 for i, k in enumerate(keys) if i % 17 == 0)
    assert got[0] is None and got[keys[-1] + 5] is None
    for r in spline.estimated(asked, "key", index).collect():
        assert (r["loc"], r["low"], r["high"]) == index.find(r["key"])


# what users bring, sources, streams


def test_custom_aggregate(frame):
    df = frame([(1, 5), (1, 9), (2, 4)], "g int, v long")
    spread = custom.aggregate_with(lambda: [], lambda s, v: [*s, v], lambda s: int(max(s) - min(s)), "long", "v")
    assert pairs(df.groupBy("g").agg(spread.alias("d"))) == [(1, 4), (2, 0)]


def test_custom_rows(spark):
    def step(batches):
        seen = 0
        for b in batches:
            seen += len(b)
            yield pd.DataFrame({"n": [seen]})

    assert custom.apply_rows(spark.range(10).coalesce(1), step, "n long").collect()[-1].n == 10


def test_page_files(spark, tmp_path):
    rows = np.rec.fromarrays([np.arange(100), np.arange(100) - 50, np.arange(100) * 2, -np.arange(100)], names="key,a,b,c")
    data = page_file.packed(rows)
    assert len(data) == 4 * 512
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(data + b"part of a page")
    got = page_file.read_pages(spark, str(tmp_path / "in"))
    assert pairs(got) == [(int(k), int(a), int(b), int(c)) for k, a, b, c in rows]
    page_file.write_pages(got, str(tmp_path / "out"))
    assert pairs(page_file.read_packed(spark, str(tmp_path / "out"))) == pairs(got)


def test_page_source(spark, tmp_path):
    page_source.register(spark)
    path = str(tmp_path / "pages")
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") - 500).cast("int").alias("a"), F.lit(1).alias("b"), F.lit(-1).alias("c"))
    rows.repartitionByRange(3, "key").sortWithinPartitions("key").write.format(page_source.FORMAT).mode("append").save(path)
    back = spark.read.format(page_source.FORMAT).load(path)
    assert pairs(back) == pairs(rows)
    assert pairs(back.where("key > 100 and key <= 140 and a < -365")) == pairs(rows.where("key > 100 and key <= 140 and a < -365"))
    assert back.where("key = 77").count() == 1 and back.where("key < 0").count() == 0
    rows.where("key < 5").coalesce(1).write.format(page_source.FORMAT).mode("overwrite").save(path)
    assert spark.read.format(page_source.FORMAT).load(path).count() == 5


def test_observed(spark):
    df, seen = scan.observed(spark.range(3, 9), "id")
    df.collect()
    assert seen.get == {"rows": 6, "min_key": 3, "max_key": 8}


def test_stream_over_batches(spark, tmp_path):
    schema = "i long, k long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    keys = [5, 3, 9, 9, 2, 11, 10, 15]
    for start in (0, 4):
        spark.createDataFrame(list(enumerate(keys))[start : start + 4], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        guarded_append(stream, out, "k", "i", str(tmp_path / "mark")).awaitTermination()
    got = spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(out)
    assert [r.k for r in got.orderBy("i").collect()] == [5, 9, 11, 15]


def test_time_windows(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id from range(0, 100, 10)")
    assert tumbling(df, "ts", "30 minutes", {"n": agg.count()}).agg(F.sum("n")).first()[0] == 10
    assert session_windows(df, "ts", "10 minutes", {"n": agg.count()}).count() == 1
    assert session_windows(df, "ts", "9 minutes", {"n": agg.count()}).count() == 10


def test_numbers_that_do_not_fit_a_record_are_refused():
    from tidemark.sources import page_file

    def rows(key, a):
        return np.rec.fromarrays([np.array([key]), np.array([a]), np.array([0]), np.array([0])], names="key,a,b,c")

    assert page_file.unpacked(page_file.packed(rows(2**32 - 1, -(2**31))))["key"][0] == 2**32 - 1
    for key, a in ((2**32 + 5, 0), (0, 2**31 + 1), (-1, 0)):
        with pytest.raises(ValueError):
            page_file.packed(rows(key, a))
    page = bytearray(page_file.packed(rows(1, 1)))
    page[page_file.COUNT_AT] = page_file.PER_PAGE + 1
    with pytest.raises(ValueError):
        page_file.unpacked(bytes(page))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2**58), st.integers(1, 2**26)), min_size=2, max_size=30), st.randoms())
def test_estimates_of_wide_keys(spark, steps, r):
    from tidemark.operators import spline

    index, key, page, pages_ = spline.Spline(), 0, 0, []
    for k, p in steps:
        index.add(key, page)
        pages_.append(key)
        key, page = key + k, page + p
    asked = [*pages_, *(r.randint(0, pages_[-1]) for _ in range(5)), pages_[-1] + 7]
    got = spline.estimated(spark.createDataFrame([(k,) for k in asked], "key long"), "key", index).collect()
    assert [(g["loc"], g["low"], g["high"]) for g in got] == [index.find(k) for k in asked]


def test_a_new_stream_starts_from_what_is_stored(spark, tmp_path):
    from tidemark.streaming import ingest as streaming

    out = str(tmp_path / "out")
    for number, keys in enumerate(([1, 5, 9], [4, 9, 10, 12])):
        source = str(tmp_path / f"in{number}")
        spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "n long, k long").coalesce(1).write.parquet(source)
        stream = spark.readStream.schema("n long, k long").parquet(source)
        streaming.guarded_append(stream, out, "k", "n", str(tmp_path / f"mark{number}")).awaitTermination()
    rows = spark.read.schema("n long, k long").option("recursiveFileLookup", "true").parquet(out)
    assert sorted(r.k for r in rows.collect()) == [1, 5, 9, 10, 12]
