"""Removal of every byte covered by a 200-byte string that starts anywhere else too, over all documents.

Sorting all suffixes externally and inducing their order with common prefixes carries several
tuples for each byte of the input; see the README for its measured cost. This operator keeps the
idea that a sample of suffixes decides for all others, but picks the sample by content (repeats.py)
and compares by hashes of whole contexts:

1. The grams of all anchors meet by hash; those seen once are dropped, with all windows they stand for.
2. Anchors whose whole contexts are equal repeat, and so do all windows that they stand for.
3. Other anchors with a gram that repeats have partly equal contexts, as at the ends of a shared
   passage. Only their windows are hashed one by one, and meet by hash.
4. The covered bytes of each text are united and cut out.

What repeats within a task's batch is settled there and sent once, so a value meets at most once
per batch, however often it comes. Equal texts are worked on once; they repeat as wholes.

Defined results: a null text counts as empty; texts shorter than the length stay whole; equal texts
that are long enough go whole; a null id stays null; repeated rows count as copies; an empty table
gives no rows; other columns are ignored (``remove_repeats`` keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import repeats as rp
from .common import digest128, drop_tables, released, tables_so_far, text_or_empty, workers_can_import, written
from .ragged import Buffer, U, groups_of, mixed, window_hash

LOWEST = -(2**63)
ANCHOR = ["place", "first", "last", "gram", "context", "before", "behind"]
#: Bits of a place in a packed range, as many as a length has in Spark; the lowest bit of a sent range tells that it is settled.
PLACE = 31


def text_key(text: Column) -> Column:
    return F.xxhash64(digest128(text))


def _parts(batches, text_column: int):
    """(texts, the batch's rows) of groups of bounded size."""
    for batch in released(batches):
        texts = [x.as_py() or b"" for x in batch.column(text_column)]
        for part in groups_of(texts, map(len, texts), rp.GROUP_BYTES):
            yield texts[part], batch.slice(part.start, part.stop - part.start)


def _sent(keys: np.ndarray, values: np.ndarray, extra: np.ndarray):
    """Rows for a meeting by hash: (where it goes, key, value or place, settled, seen twice).

    A value that repeats here is settled for all its rows; one of them goes on, marked, to meet the
    others; the rest go anywhere.
    """
    many, first = rp.repeated_here(values, keys)
    onward = values.view(np.int64)
    aside = mixed(keys.view(U) + extra.astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)
    return np.where(first, onward, aside), many


def _grams(texts: DataFrame) -> DataFrame:
    """(key, gram) of the grams that come more than once."""

    def run(batches):
        for raw, rows in _parts(batches, 1):
            keys = rows.column(0).to_numpy()
            found = rp.anchors(Buffer(raw))
            key, gram = keys[found.doc], found.gram
            # one row per text and gram, and whether it comes twice in the text; copies in the batch count once
            text = np.unique(keys, return_index=True)[1]
            own = np.isin(found.doc, text)
            key, gram = key[own], gram[own]
            order = np.lexsort((key, gram))
            key, gram = key[order], gram[order]
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (gram[1:] != gram[:-1])]) if len(key) else np.zeros(0, np.int64)
            twice = np.diff(np.r_[new, len(key)]) > 1
            key, gram = key[new], gram[new]
            route, many = _sent(key, gram, gram)
            many |= twice
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(key), pa.array(gram.view(np.int64)), pa.array(many)], names=["route", "key", "gram", "many"])

    rows = texts.mapInArrow(run, "route long, key long, gram long, many boolean")
    group = Window.partitionBy("route")
    # copies of a text in other batches aren't another text, so keys are compared
    met = rows.withColumn("_a", F.min("key").over(group)).withColumn("_b", F.max("key").over(group)).withColumn("_m", F.max("many").over(group))
    return met.where((F.col("_a") != F.col("_b")) | F.col("_m")).select("key", "gram")


def _marked(texts: DataFrame) -> DataFrame:
    """Texts (key, text, grams) with their anchors of those grams: places and hashes."""

    def run(batches):
        for raw, rows in _parts(batches, 1):
            found = rp.anchors(buffer := Buffer(raw))
            keep = np.zeros(len(found.doc), bool)
            bounds = np.searchsorted(found.doc, np.arange(len(raw) + 1))
            for d, grams in enumerate(rows.column(2)):
                some = slice(bounds[d], bounds[d + 1])
                keep[some] = np.isin(found.gram[some].view(np.int64), grams.values.to_numpy())
            counts = np.bincount(found.doc[keep], minlength=len(raw))
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            start = buffer.starts[found.doc[keep]]
            columns = [(x[keep] - start).astype(np.int32) for x in (found.place, found.first, found.last)]
            columns += [x[keep].view(np.int64) for x in (found.gram, found.context, found.before, found.behind)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)], names=["key", "text", *ANCHOR])

    return texts.mapInArrow(run, "key long, text binary, " + ", ".join(f"{c} array<{'int' if c in ANCHOR[:3] else 'long'}>" for c in ANCHOR))


def _windows(texts: DataFrame) -> DataFrame:
    """(key, packed range): windows of the ranges of each text (key, text, ranges) that come more than once among all of them."""

    def run(batches):
        for raw, rows in _parts(batches, 1):
            buffer = Buffer(raw)
            ranges = rows.column(2)
            doc = np.repeat(np.arange(len(raw)), ranges.value_lengths().to_numpy())
            flat = ranges.flatten()
            at, of = rp.expanded(flat.field(0).to_numpy() + buffer.starts[doc], flat.field(1).to_numpy() + buffer.starts[doc])
            doc = doc[of]
            key, place = rows.column(0).to_numpy()[doc], at - buffer.starts[doc]
            hashes = window_hash(buffer.prefix(rp.WINDOW_SEED), at, at + rp.LENGTH)
            route, many = _sent(key, hashes, place.astype(np.int64))
            # settled windows that need not meet any others go as ranges
            lone = many & (route != hashes.view(np.int64))
            k, p = key[lone], place[lone]
            new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)]) if len(k) else np.zeros(0, np.int64)
            stop = np.r_[new[1:], len(k)] - 1 if len(k) else new
            sent = ~lone
            first, last = np.r_[place[sent], p[new]], np.r_[place[sent], p[stop]]
            span = (((first << PLACE) | last) << 1) | np.r_[many[sent], np.ones(len(new), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[route[sent], route[lone][new]]), pa.array(np.r_[key[sent], k[new]]), pa.array(span)], names=["route", "key", "span"])

    group = Window.partitionBy("route")
    settled = F.col("span").bitwiseAND(F.lit(1))
    met = texts.mapInArrow(run, "route long, key long, span long").withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_m", F.max(settled).over(group))
    return met.where((F.col("_n") > 1) | (F.col("_m") == 1)).select("key", F.shiftright("span", 1).alias("range"))


def _cut(texts: DataFrame, with_text: bool) -> DataFrame:
    """Per text (key, text, packed ranges): bytes and runs removed, and the digest (and text) of what is left."""

    def run(batches):
        for batch in released(batches):
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                raw = text.as_py()
                span = ranges.values.to_numpy()
                a, b = rp.removed(len(raw), span >> PLACE, span & ((1 << PLACE) - 1))
                kept = b"".join(raw[x:y] for x, y in zip(np.r_[0, b].tolist(), np.r_[a, len(raw)].tolist()))
                out.append((len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    cut = texts.mapInArrow(run, "key long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return cut if with_text else cut.drop("kept")


def _repeats(plain: DataFrame, rows: DataFrame, with_text: bool) -> DataFrame:
    """What is cut out of each text that isn't whole a copy. ``plain``: id, key, text; ``rows``: id, key, n_bytes of all of them."""
    long = plain.where(F.octet_length("text") >= rp.LENGTH)
    found = _grams(long.select("key", "text")).groupBy("key").agg(F.collect_set("gram").alias("grams"))
    one = rows.where(F.col("n_bytes") >= rp.LENGTH).groupBy("key").agg(F.min("id").alias("id"))
    wanted = found.join(one, "key")
    marked = written(_marked(long.join(wanted, ["key", "id"]).select("key", "text", "grams")), "marked")
    each = marked.select("key", F.explode(F.arrays_zip(*ANCHOR)).alias("x")).select("key", "x.*")
    alike = written(each.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("least"), F.min("before").alias("before"), F.min("behind").alias("behind")), "alike")
    # written, as are the other tables that are joined by a gram, so that both sides are dealt anew and Spark can split a hot one
    kinds = written(alike.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram"), "kinds")
    many = written(alike.join(kinds, "gram").select("gram", "context", "before", "behind"), "many")
    # other contexts that go on alike before, or behind: else no window that reaches so far can repeat
    before = written(many.groupBy("gram", "before").agg((F.count(F.lit(1)) > 1).alias("reach_before")), "before")
    behind = written(many.groupBy("gram", "behind").agg((F.count(F.lit(1)) > 1).alias("reach_behind")), "behind")
    partly = many.join(before, ["gram", "before"]).join(behind, ["gram", "behind"]).where("reach_before or reach_behind")
    flags = alike.join(partly.select("gram", "context", "reach_before", "reach_behind"), ["gram", "context"], "left").where((F.col("n") > 1) | F.col("reach_before").isNotNull())
    flags = written(flags.select("gram", "context", "n", "least", "reach_before", "reach_behind"), "flags")
    judged = each.drop("before", "behind").join(flags, ["gram", "context"])
    whole = F.col("n") > 1
    # of anchors with equal contexts one is enough to meet others
    meets = F.col("reach_before").isNotNull() & (~whole | ((F.col("least.key") == F.col("key")) & (F.col("least.place") == F.col("place"))))
    nearest = F.when(F.col("reach_before"), F.col("first")).otherwise(F.greatest("first", F.col("place") - rp.HALF + 1))
    farthest = F.when(F.col("reach_behind"), F.col("last")).otherwise(F.least("last", F.col("place") - rp.HALF - 1))
    packed = F.shiftleft(F.col("first").cast("long"), PLACE).bitwiseOR(F.col("last").cast("long"))
    judged = written(judged.select("key", packed.alias("range"), whole.alias("whole"), (meets & (nearest <= farthest)).alias("meets"), nearest.alias("first"), farthest.alias("last")).where("whole or meets"), "judged")
    ranges = F.sort_array(F.collect_list("range")).alias("ranges")
    open_ = judged.where("meets").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    covers = judged.where("whole").select("key", "range").unionByName(_windows(marked.select("key", "text").join(open_, "key").select("key", "text", "ranges")))
    return _cut(marked.select("key", "text").join(covers.groupBy("key").agg(ranges), "key").select("key", "text", "ranges"), with_text)


def _prepared(docs: DataFrame, id_col: str, text_col: str):
    text = text_or_empty(text_col)
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), text_key(text).alias("key"), text.cast("binary").alias("text"))
    return text, plain


def count_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans (maximal removed runs) and the digest of the bytes that are left."""
    workers_can_import(docs.sparkSession)
    text, plain = _prepared(docs, id_col, text_col)
    rows = written(docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), text_key(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole")), "rows")
    cut = _repeats(plain, rows, False)
    copies = rows.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("copied"))
    all_gone = F.col("copied") & (F.col("n_bytes") >= rp.LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.join(copies.join(cut, "key", "left"), "key").select(
        F.col(id_col),
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of their texts; a character that lost some of its bytes goes whole. Other columns stay."""
    workers_can_import(docs.sparkSession)
    since = tables_so_far(docs.sparkSession)
    text, plain = _prepared(docs, id_col, text_col)
    rows = written(plain.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    cut = _repeats(plain, rows, True).select(F.col("key").alias("_tm_key"), F.col("kept").alias("_tm_kept"))
    copies = rows.where(F.col("n_bytes") >= rp.LENGTH).groupBy("key").count().where("count > 1").select(F.col("key").alias("_tm_key"), F.lit("").alias("_tm_kept"))
    changed = written(copies.unionByName(cut.join(copies.select("_tm_key"), "_tm_key", "left_anti")), "changed")
    drop_tables(docs.sparkSession, since, keep=1)  # the result reads ``docs`` and this one only
    joined = docs.withColumn("_tm_key", text_key(text)).join(changed, "_tm_key", "left")
    return joined.withColumn(text_col, F.coalesce("_tm_kept", F.col(text_col))).select(*docs.columns)
