"""Connected components of a table of links, by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, tables_so_far, written_and_seen


def _told(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges as a table, their number and a sum over all of them, to see whether a round changed anything."""
    edges, seen = written_and_seen(edges, "edges", hashes=F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    return edges, (seen["n"], seen["hashes"])


def components(links: DataFrame) -> DataFrame:
    """Per linked node (columns a and b, longs): node and root, the smallest node that it is connected with.

    A large-star step hangs a node's larger neighbours on its smallest one, a small-star step hangs
    its smaller ones there; they alternate until nothing changes, about log(nodes) times.
    """
    spark = links.sparkSession
    edges, before = _told(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges, after = _told(small.where("a <> b").distinct())
        drop_tables(spark, tables_so_far(spark) - 2, keep=1)  # the round before
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
