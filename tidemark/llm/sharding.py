"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that stays whole. Groups go, largest first, into the bin with
the least capacity left that still holds them; the bins are kept in a balanced tree. All groups
of one size go together: after one of them enters a bin that bin is the tightest one left, so a
bin takes as many as fit before the next one is asked for, exactly as group by group. The driver
therefore needs only the histogram of group sizes. Different sizes number at most the square root
of twice the total, whatever the number of rows.

Defined results: null texts count as empty ones; repeated rows belong to one group; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .balanced import BalancedTree
from .common import digest128, gapless, text_or_empty, written


def pack_sizes(sizes, counts, capacity: int, bins: int | None = None):
    """Best-fit-decreasing over a histogram. ``sizes`` falls strictly; none is above ``capacity``.

    Returns runs (size, first, last, bin): of the groups of that size, numbered from 0, those from
    first to before last go into the bin. None if more than ``bins`` bins are needed.
    """
    left = BalancedTree()
    used, runs = 0, []
    for size, n in zip(sizes, counts):
        size, first = int(size), 0
        while first < n:
            room = left.at_least((size, -1))
            if room is None:
                if bins is not None and used == bins:
                    return None
                room = (capacity, used)
                used += 1
            else:
                left.remove(room)
            took = min(n - first, room[0] // size)
            runs.append((size, first, first + took, room[1]))
            if room[0] - took * size:
                left.add((room[0] - took * size, room[1]))
            first += took
    return runs


def pack_into(sizes, counts, bins: int):
    """Runs for exactly ``bins`` bins of the smallest capacity found, so that the bins come out near equal.

    A group above the mean of what is left gets a bin of its own, as it would raise the capacity of
    all others.
    """
    sizes, counts = [int(s) for s in sizes], [int(c) for c in counts]
    runs, at, total = [], 0, sum(s * c for s, c in zip(sizes, counts))
    taken = [0] * len(sizes)
    alone = 0
    while at < len(sizes) and bins - alone > 1 and sizes[at] * (bins - alone) > total:
        runs.append((sizes[at], taken[at], taken[at] + 1, alone))
        taken[at] += 1
        total -= sizes[at]
        alone += 1
        at += taken[at] == counts[at]
    rest, many, skip = sizes[at:], [c - t for c, t in zip(counts[at:], taken[at:])], taken[at:]
    if not rest:
        return runs
    low = max(rest[0], -(-total // (bins - alone)))
    step, best = 1, pack_sizes(rest, many, low, bins - alone)
    if best is None:
        bad = low
        while best is None:
            good = low + step
            best = pack_sizes(rest, many, good, bins - alone)
            bad, step = (bad, step) if best else (good, step * 4)
        while good - bad > max(1, good // 1_000_000):
            mid = (good + bad) // 2
            found = pack_sizes(rest, many, mid, bins - alone)
            if found is None:
                bad = mid
            else:
                good, best = mid, found
    first = dict(zip(rest, skip))
    return runs + [(s, a + first[s], b + first[s], k + alone) for s, a, b, k in best]


RUNS = T.StructType([T.StructField("group_size", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("shard", T.IntegerType())])


def shard_documents(docs: DataFrame, shards: int | None = 40, capacity: int | None = None, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard and its gapless slot there.

    With ``shards`` that many bins of the least capacity; with ``capacity`` as few bins of that size
    as best fit finds (a larger group then gets a bin of its own).
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = written(docs.select(F.col(id_col), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest128(text).alias("group_key")), "shard-rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    classes = [(r[0], r[1]) for r in groups.groupBy("group_size").count().orderBy(F.desc("group_size")).toLocalIterator()]
    sizes, counts = [c[0] for c in classes], [c[1] for c in classes]
    if capacity is None:
        runs = pack_into(sizes, counts, shards)
    else:
        large = [(s, i, i + 1) for s, c in classes if s > capacity for i in range(c)]
        runs = [(*x, k) for k, x in enumerate(large)]
        runs += [(s, a, b, k + len(large)) for s, a, b, k in pack_sizes([s for s in sizes if s <= capacity], [c for s, c in classes if s <= capacity], capacity)]
    bins = spark.createDataFrame(runs, RUNS)
    numbered = gapless(groups, ["group_size"], ["group_key"], "n")
    placed = numbered.join(bins, "group_size").where((F.col("n") >= F.col("first")) & (F.col("n") < F.col("last"))).select("group_key", "shard")
    return gapless(written(rows.join(placed, "group_key").select(id_col, "size", "text_crc32", "shard", "group_key"), "shard-placed"), ["shard"], [id_col, "group_key"], "slot").drop("group_key")


def shard_balance(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def largest_excess(bytes_by_shard) -> float:
    """By how much the fullest shard is above the mean, as a share of it."""
    x = np.asarray(list(bytes_by_shard), dtype=float)
    return float(x.max() / x.mean() - 1) if len(x) else 0.0
