"""Near-duplicate classes by weighted MinHash: consistent samples in bands, links verified by weighted Jaccard.

Equal texts are one node. Nodes that share a band key are in one bucket; two of them are linked if
their weighted Jaccard similarity reaches the threshold, and classes are the components of links.
Pairs of a bucket aren't sent out one by one:

1. Of each very large bucket one member, a pivot, is compared with all others; that joins most copies
   of one base. A pivot needs no more comparisons in any bucket.
2. In large buckets that are still in several components, members outside the largest component meet
   all members of other components, in blocks of a bounded number of members and shingles, so that
   a text is sent once for many others; a block compares by products of matrices and sends the
   links that join something. Members whose sums of weights are so far apart
   that they can't reach the threshold are in other blocks and don't meet.
3. In small buckets, members outside the largest component are pivots.

A pair is left out only if it is in one component already or if the sums of weights rule it out,
which is exact. A bucket is done when those of its members that were never pivots are in one
component, since then every pair across components has been compared. No link between components is
lost. Links that were found are kept: each row has the number of its text's verified links and the
greatest similarity among them; of links within a component only those are verified that joined it.

Defined results: null and empty texts and texts without words are linked only to equal ones; rows
with one id are one document, that of its text with the least digest; a class without any id has a null class_id, and a row without an id has
the class of its text; ids are below 2**62; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import weighted_minhash as wm
from .common import among, digest128, drop_tables, released, tables_so_far, text_or_empty, workers_can_import, written, written_and_seen
from .links import components

SLICES = 16
#: Nodes of texts that have no id are hashes from here on, above all ids.
NAMELESS = 1 << 62
#: Members of a very large and of a large bucket.
VERY_LARGE, LARGE = 256, 48
#: About how many members and different shingles a block has at most (matrices of 2 MB, and some 3 MB of shingles and counts).
BLOCK, BLOCK_SHINGLES = 512, 1 << 17
#: Similarities are compared with so much of a margin for the order of additions.
MARGIN = 1e-9


def sketch(texts: DataFrame) -> np.ndarray:
    """The counters of all documents. ``texts`` has one binary column; tasks send packed slices that are summed in as many groups."""

    def count(batches):
        counters = np.zeros((wm.ROWS, wm.WIDTH), np.uint32)
        for batch in released(batches):
            raw = batch.column(0).to_pylist()
            for part in wm.groups_of(raw, map(len, raw), wm.GROUP_BYTES):
                for first in range(part.start, part.stop, 1 << wm.DOC_BITS):
                    shingle, _, _ = wm.document_shingles(raw[first : min(part.stop, first + (1 << wm.DOC_BITS))])
                    for r, slot in enumerate(wm.slots(shingle)):
                        np.add.at(counters[r], slot, np.uint32(1))
        slices = np.split(counters.reshape(-1), SLICES)
        some = [k for k, s in enumerate(slices) if s.any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_packed(slices[k]) for k in some], pa.binary())], names=["slice", "packed"])

    def add(key, rows):
        total = np.zeros(wm.ROWS * wm.WIDTH // SLICES, np.uint64)
        for x in rows.column("packed"):
            total += _unpacked(x.as_py())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([_packed(total)], pa.binary())})

    packed = texts.mapInArrow(count, "slice int, packed binary")
    packed = packed.groupBy("slice", F.pmod(F.xxhash64("packed"), F.lit(32))).applyInArrow(add, "slice int, packed binary").groupBy("slice").applyInArrow(add, "slice int, packed binary")
    counters = np.zeros(wm.ROWS * wm.WIDTH, np.uint64).reshape(SLICES, -1)
    for k, x in packed.toLocalIterator():  # 16 MB at any size of the input
        counters[k] = _unpacked(bytes(x))
    return counters.reshape(wm.ROWS, wm.WIDTH)


def _packed(counters: np.ndarray) -> bytes:
    """Counters in the fewest bytes that hold the largest, compressed; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if int(counters.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(counters.astype(f"<u{width}").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"<u{packed[0]}").astype(np.uint64)


def similar(pairs: DataFrame, texts: DataFrame, sent, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a pivot a, a node b) whose texts (node, text) reach the threshold, with their similarity.

    A node's text goes to its pivot's, which isn't sent out with each pair.
    """

    def judge(batches):
        weights = lru_cache(maxsize=16)(lambda text: wm.Weights(text, sent.value))
        for batch in released(batches):
            near = [weights(x.as_py()).likeness(weights(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
            found = pa.table([batch.column(0), batch.column(1), pa.array(near, pa.float64())], names=["a", "b", "similarity"])
            yield from found.filter(pa.array([x >= threshold - MARGIN for x in near], pa.bool_())).to_batches()

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(judge, LINK)


LINK = "a long, b long, similarity double"


def classified(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, digest of its text, root (the least node of its class), n_links and top_similarity."""
    spark = docs.sparkSession
    workers_can_import(spark)
    text = text_or_empty(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"))
    sent = spark.sparkContext.broadcast(wm.Frequencies(sketch(plain.select("text")), plain.count()))

    def sign(batches):
        for batch in released(batches):
            keys, size, total = map(np.concatenate, zip(*wm.signatures(batch.column(2).to_pylist(), sent.value)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), wm.BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(total), lists], names=["id", "digest", "size", "total", "bands"])

    signed = plain.select("id", digest128(F.col("text")).alias("digest"), "text").mapInArrow(sign, "id long, digest binary, size long, total double, bands array<long>")
    signed = written(signed, "signed")
    nodes = signed.groupBy("digest").agg(F.min("id").alias("id")).select("digest", F.coalesce("id", nameless(F.col("digest"))).alias("node"))
    # written, as other tables that are joined by a key that may be hot, so that both sides are dealt anew and Spark can split it
    nodes = written(nodes, "nodes")
    members = written(signed.select("id", "digest").join(nodes, "digest"), "members")
    own = nodes.groupBy("node").agg(F.min("digest").alias("digest"))
    bands = signed.where("size > 0").withColumn("node", _node_of(F.col("id"), F.col("digest"))).join(own, ["node", "digest"])
    bands = written(bands.dropDuplicates(["node", "digest"]).select("node", "digest", "size", "total", "bands"), "bands")
    buckets = bands.select("node", "size", "total", F.explode("bands").alias("bucket"))
    shared = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    open_ = written(buckets.join(shared, "bucket"), "buckets")  # members of buckets that aren't done
    candidates, seen = written_and_seen(bands.select("node", "digest").join(open_.select("node").distinct(), "node"), "candidates")
    texts = written(_texts(plain, candidates, seen["n"]), "texts")
    state = open_.withColumn("root", F.col("node"))  # members that were never pivots
    first, seen = written_and_seen(_pivots(state, VERY_LARGE), "pivots")
    links, roots = spark.createDataFrame([], LINK), spark.createDataFrame([], "node long, root long")

    def joined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = written(found, "links")
        return links.unionByName(new), components(new.select("a", "b").unionByName(_as_links(roots)))

    if seen["n"]:
        links, roots = joined(similar(_pairs(state, first, threshold), texts, sent, threshold))
        state = _undone(state, first, roots)
    large, seen = written_and_seen(state.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LARGE).select("bucket"), "large")
    if seen["n"]:
        links, roots = joined(_in_blocks(written(state.join(large, "bucket"), "open"), texts, sent, threshold))
        state = _undone(state.join(large, "bucket", "left_anti"), first, roots)
    links, roots = joined(similar(_pairs(state, written(_outsiders(state), "pivots"), threshold), texts, sent, threshold))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    told = ends.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"), F.max("similarity").alias("top_similarity"))
    per = written(roots.join(told, "node", "left"), "classes")
    classes = members.join(per, "node", "left")
    return classes.select("id", "digest", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "top_similarity")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, class_id (the smallest id of its class), n_links and top_similarity (of its text with other texts; null without links)."""
    classes = classified(docs, threshold, id_col, text_col)
    return classes.select(F.col("id").alias(id_col), F.when(F.col("root") < NAMELESS, F.col("root")).alias("class_id"), "n_links", "top_similarity")


def nameless(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))


def _node_of(id_: Column, digest: Column) -> Column:
    return F.coalesce(id_, nameless(digest))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the smallest id, among those of one id (or of none) that with the least digest. Other columns stay."""
    since = tables_so_far(docs.sparkSession)
    classes = classified(docs, threshold, id_col, text_col)
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("kept"))
    kept = written(kept.select(F.col("kept.id").alias("_tm_id"), F.col("kept.digest").alias("_tm_digest")), "kept")
    drop_tables(docs.sparkSession, since, keep=1)  # the result reads ``docs`` and this one only
    keyed = docs.withColumn("_tm_id", F.col(id_col).cast("long")).withColumn("_tm_digest", digest128(text_or_empty(text_col)))
    # nulls are no keys of joins
    named = keyed.withColumn("_tm_key", _node_of(F.col("_tm_id"), F.col("_tm_digest"))).drop("_tm_id")
    wanted = kept.select(_node_of(F.col("_tm_id"), F.col("_tm_digest")).alias("_tm_key"), "_tm_digest")
    one = Window.partitionBy("_tm_key", "_tm_digest").orderBy(F.lit(0))
    return named.join(wanted, ["_tm_key", "_tm_digest"], "left_semi").withColumn("_tm_place", F.row_number().over(one)).where("_tm_place = 1").select(*docs.columns)


def _texts(plain: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The text of each node of the ``n`` ``rows`` (node, digest): that of a row whose id the node has and whose digest is the node's."""
    keyed = plain.withColumn("digest", digest128(F.col("text")))
    held = among(keyed, F.col("digest"), rows.select("digest"), n).withColumn("node", _node_of(F.col("id"), F.col("digest")))
    return held.join(rows, ["node", "digest"]).groupBy("node", "digest").agg(F.first("text").alias("text")).select("node", "text")


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _undone(state: DataFrame, pivots: DataFrame, roots: DataFrame) -> DataFrame:
    """Members that were never pivots, with their roots, of buckets in which they are in several components."""
    fresh = state.drop("root").join(pivots, "node", "left_anti").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    undone = fresh.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    undone = written(undone, "undone")
    return written(fresh.join(undone, "bucket"), "state")


def _largest(state: DataFrame) -> DataFrame:
    """Per bucket: its members and its largest component's members, root and first member."""
    sizes = state.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    return written(sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("root")).alias("r"), "first")).alias("top")), "largest")


def _pivots(state: DataFrame, members_from: int) -> DataFrame:
    """The first member of the largest component of each bucket with so many members."""
    return _largest(state).where(F.col("all") >= members_from).select(F.col("top.first").alias("node")).distinct()


def _outsiders(state: DataFrame) -> DataFrame:
    """All members outside their bucket's largest component."""
    return state.join(_largest(state), "bucket").where(F.col("root") != -F.col("top.r")).select("node").distinct()


def _in_blocks(state: DataFrame, texts: DataFrame, sent, threshold: float) -> DataFrame:
    """Links (a, b, similarity) between members outside a bucket's largest component and all members of other components.

    Members are dealt by the logarithm of their sum of weights to classes, so that two that can reach
    the threshold are in one class or in neighbouring ones, and within a class by a hash to blocks of
    about BLOCK members and BLOCK_SHINGLES shingles at most (one text may have more). Each block of outsiders meets each block of members of its class and the
    two beside it; a group has no more than the members of two blocks.
    """
    sides = state.join(_largest(state), "bucket").withColumn("out", F.col("root") != -F.col("top.r"))
    sides = sides.withColumn("c", F.floor(F.log("total") / F.lit(-math.log(threshold - MARGIN))).cast("int")).select("bucket", "node", "root", "size", "out", "c")
    blocks = lambda n, shingles: F.ceil(F.greatest(n / F.lit(BLOCK), shingles / F.lit(BLOCK_SHINGLES))).cast("int")
    outside = F.col("out").cast("int")
    sizes = sides.groupBy("bucket", "c").agg(blocks(F.count(F.lit(1)), F.sum("size")).alias("every"), blocks(F.sum(outside), F.sum(outside * F.col("size"))).alias("outside"))
    sizes = written(sizes, "sizes")
    of = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    there = sizes.select("bucket", F.col("c").alias("d"), F.col("every").alias("d_every"), F.col("outside").alias("d_outside"))
    near = sides.join(sizes, ["bucket", "c"]).withColumn("d", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))).join(there, ["bucket", "d"])
    left = near.where("out").select("bucket", "node", "root", F.lit(0).alias("side"), "c", "d", of(F.col("outside")).alias("i"), numbers(F.col("d_every")).alias("j"))
    right = near.where("d_outside > 0").select("bucket", "node", "root", F.lit(1).alias("side"), F.col("d").alias("c"), F.col("c").alias("d"), numbers(F.col("d_outside")).alias("i"), of(F.col("every")).alias("j"))
    rows = left.unionByName(right).join(texts, "node").select("bucket", "c", "d", "i", "j", "side", "node", "root", "text")

    def compare(table: pa.Table) -> pa.Table:
        weights = lru_cache(maxsize=None)(lambda text: wm.Weights(text, sent.value))
        side = table.column("side").to_numpy()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        each = [weights(t.as_py()) for t in table.column("text")]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        like = wm.likenesses([each[k] for k in a], [each[k] for k in b])
        near = (like >= threshold - MARGIN) & (root[a][:, None] != root[b][None, :])
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while joined.setdefault(x, x) != x:
                joined[x] = x = joined[joined[x]]
            return x

        links = []
        for x, y in zip(*np.nonzero(near)):
            p, q = top(int(root[a[x]])), top(int(root[b[y]]))
            if p != q:
                joined[p] = q
                links.append((int(node[a[x]]), int(node[b[y]]), float(like[x, y])))
        columns = list(zip(*links)) or [()] * 3
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float64())})

    return rows.groupBy("bucket", "c", "d", "i", "j").applyInArrow(compare, LINK)


def _pairs(state: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a pivot a, a node b) of different components that share a bucket and may reach the threshold by their sums of weights."""
    full = state.join(chosen.withColumn("pivot", F.lit(True)), "node", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    mine = full.where("pivot").select("bucket", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("total").alias("a_total"))
    other = full.select(F.col("bucket").alias("b_bucket"), F.col("node").alias("b"), "root", "total", "pivot")
    may = F.least("total", "a_total") >= (threshold - MARGIN) * F.greatest("total", "a_total")
    # two pivots meet once
    met = mine.join(other, (F.col("bucket") == F.col("b_bucket")) & (F.col("root") != F.col("a_root")) & (~F.col("pivot") | (F.col("a") < F.col("b"))) & may)
    return met.select("a", "b").distinct()
