"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each component of the vectors of a block is a list sorted by value. A query reads every list from
the end that serves its sign, in rounds of doubling depth. A vector's score lies between what has
been read of it plus the least, and plus the most, that its unread components can add (the values
where the lists stand). Vectors whose upper bound is below the k-th best lower bound drop out. Each
query stops on its own as soon as few vectors are left, whose scores are then resolved; one whose
bounds stay wide reads its lists to the end, where all bounds are scores. A task carries the k-th
best score from block to block, so later blocks stop earlier. The bounds are computed for many
queries at once as matrix products of the read and the unread parts.

Defined results: vectors that are null, have a null or non-finite component, or a null id take no
part; shorter vectors count as filled with zeros; rows with a query's own id aren't its candidates;
a query id that repeats is asked once, with the smallest of its vectors; repeated rows are
candidates each; an empty table gives no rows; other columns are ignored. Components have any size;
a score beyond 64 bits is held at the end of that range, as its column is a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import workers_can_import

#: Vectors whose lists are sorted together; queries that read them together.
BLOCK, BATCH = 8192, 256
#: The first round reads this part of the lists; a query stops with so many vectors left, or so small a part of them.
FIRST, FEW, PART = 64, 64, 50
#: Bytes of query vectors sent to the tasks at once; more of them take more passes over the vectors.
PASS_BYTES = 1 << 25


class Lists:
    """The sorted lists of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def read(self, depth: int):
        """What has been read from the high and from the low ends, and where these lists stand."""
        n, d = self.vectors.shape
        high, low = np.zeros((n, d), bool), np.zeros((n, d), bool)
        np.put_along_axis(high, self.order[n - depth :], True, axis=0)
        np.put_along_axis(low, self.order[:depth], True, axis=0)
        return high, low, self.sorted[n - depth], self.sorted[depth - 1]


def best(lists: Lists, queries: np.ndarray, k: int, floor: np.ndarray, own) -> list:
    """(places, exact scores, share of the lists that was read) of each query's candidates that may be among its k best.

    ``floor`` holds a score per query that k other vectors reach; ``own`` are masks of a query's own rows, or None.
    """
    c = lists.vectors
    n = len(c)
    limit = int(np.abs(c).max(initial=0)) * int(np.abs(queries).sum(axis=1).max(initial=0))
    kind = np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else object
    c = c.astype(kind)
    plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    out, active, depth = [None] * len(queries), np.arange(len(queries)), max(1, n // FIRST)
    while len(active):
        depth = min(n, depth)
        high, low, at_high, at_low = lists.read(depth)
        p, m = plus[active], minus[active]
        seen = p @ np.where(high, c, 0).T.astype(kind) + m @ np.where(low, c, 0).T.astype(kind)
        upper, lower = seen, seen.copy()
        if depth < n:
            open_high, open_low = (~high).T.astype(kind), (~low).T.astype(kind)
            upper = seen + (p * at_high.astype(kind)) @ open_high + (m * at_low.astype(kind)) @ open_low
            lower = seen + (p * lists.sorted[0].astype(kind)) @ open_high + (m * lists.sorted[-1].astype(kind)) @ open_low
        free = np.ones(seen.shape, bool) if own is None else ~own[active]
        lower[~free] = -np.inf
        bar = floor[active]
        if n > k:
            kth = (np.sort(lower, axis=1) if kind is object else np.partition(lower, n - k, axis=1))[:, n - k]
            bar = np.where(kth > bar, kth, bar)
        alive = free & (upper >= bar[:, None])
        done = np.full(len(active), True) if depth == n else alive.sum(axis=1) <= max(FEW, n // PART)
        for i in np.flatnonzero(done):
            rows = np.flatnonzero(alive[i])
            if depth == n:
                scores = seen[i, rows] if kind is object else seen[i, rows].astype(np.int64)
            else:
                scores = lists.vectors[rows] @ queries[active[i]]
            out[active[i]] = rows, scores, depth / n
        active = active[~done]
        depth *= 2
    return out


def quantised(vectors) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that take part, their components as floor(256 x)) of an Arrow list array."""
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
    offsets = np.r_[0, np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
    good = np.isfinite(values)
    if flat.null_count:
        good &= flat.is_valid().to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~good)]
    fit = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows = np.flatnonzero(fit)
    lengths = np.diff(offsets)[rows]
    out = np.zeros((len(rows), int(lengths.max(initial=0))), np.int64)
    for d in np.unique(lengths):
        same = np.flatnonzero(lengths == d)
        if d:
            at = offsets[rows[same]][:, None] + np.arange(d)
            whole = np.floor(256 * values[at])
            if (np.abs(whole) >= 2.0**62).any():  # beyond 64 bits, or nearly: Python's numbers
                out = out.astype(object)
                whole = np.array([[int(x) << 8 if abs(x) >= 2.0**53 else int(y) for x, y in zip(*r)] for r in zip(values[at], whole)], dtype=object)
            out[same, :d] = whole if out.dtype == object else whole.astype(np.int64)
    return rows, out


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x


def _held(scores) -> np.ndarray:
    """Scores as 64-bit numbers."""
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores], np.int64)


def top_scores(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", with_share: bool = False) -> DataFrame:
    """Each query's k best rows: query_id, rank, id, score; ties go to the smaller id.

    ``with_share`` adds share_read, the mean share of the lists of all blocks that was read for the query.
    """
    spark = rows.sparkSession
    workers_can_import(spark)
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole).groupBy("id").agg(F.min("v").alias("v"))
    told = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    passes = max(1, -(-told[0] * 8 * max(1, told[1] or 0) // PASS_BYTES))
    found = None
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).toArrow() if passes > 1 else asked.toArrow()
        at, vectors = quantised(part.column("v").combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64())))
        sent = spark.sparkContext.broadcast((part.column("id").to_numpy()[at], vectors))

        def run(batches, sent=sent):
            ids, q = sent.value
            floor = np.full(len(ids), -np.inf, object if q.dtype == object else np.float64)
            kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
            read, there = np.zeros(len(ids)), 0
            for block in _blocks_of(batches):
                others, c = block
                width = max(q.shape[1], c.shape[1])
                lists, qs = Lists(_wide(c, width)), _wide(q, width)
                there += len(c)
                for a in range(0, len(ids), BATCH):
                    some = slice(a, a + BATCH)
                    hit = np.isin(ids[some], others)
                    own = (ids[some][:, None] == others[None, :]) if hit.any() else None
                    for i, (r, s, share) in enumerate(best(lists, qs[some], k, floor[some], own), a):
                        read[i] += share * len(c)
                        got, score = np.r_[kept[i][0], others[r]], np.r_[kept[i][1], s]
                        order = np.lexsort((got, -score))[:k]
                        kept[i] = (got[order], score[order])
                        if len(order) == k:
                            floor[i] = kept[i][1][-1]
            n = [len(x[0]) for x in kept]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([x[0] for x in kept])), pa.array(_held(np.concatenate([x[1] for x in kept]))), pa.array(np.repeat(read, n)), pa.array(np.full(sum(n), float(there)))], names=["query_id", "vec_id", "score", "read", "there"])

        one = source.mapInArrow(run, "query_id long, vec_id long, score long, read double, there double")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if with_share:  # each task tells its share with each of its rows
        all_ = Window.partitionBy("query_id")
        part = F.row_number().over(Window.partitionBy("query_id", "task").orderBy(F.lit(0))) == 1
        found = found.withColumn("task", F.spark_partition_id()).withColumn("one", part)
        found = found.withColumn("share_read", F.sum(F.when(F.col("one"), F.col("read"))).over(all_) / F.sum(F.when(F.col("one"), F.col("there"))).over(all_))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *(["share_read"] if with_share else []))


def _blocks_of(batches):
    """(ids, integer vectors) of BLOCK rows at a time."""
    ids, parts, n = [], [], 0

    def joined():
        width = max(p.shape[1] for p in parts)
        return np.concatenate(ids), np.concatenate([_wide(p, width) for p in parts])

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            at, v = quantised(piece.column(1))
            if len(at):
                ids.append(piece.column(0).to_numpy()[at])
                parts.append(v)
                n += len(at)
            if n >= BLOCK:
                yield joined()
                ids, parts, n = [], [], 0
    if n:
        yield joined()
