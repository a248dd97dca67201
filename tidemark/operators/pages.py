"""Pages: row numbers to pages, summaries of pages, and pruning by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import Buckets, in_mask, overlaps
from .ordered import ROWS_PER_BLOCK, Ordered
from .scan import in_range

#: Ranges of keys that a pruned scan asks for at most.
RANGES = 64


def with_pages(df: DataFrame, key: str, per_page: int, out: str = "page_id", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Each row's page when rows fill pages in key order."""
    return Ordered(df, key, (), rows_per_block).position(out).withColumn(out, F.expr(f"`{out}` div {int(per_page)}"))


def page_summary(paged: DataFrame, key: str, data: str, buckets: Buckets | None = None, page: str = "page_id") -> DataFrame:
    """One row per page: rows, least and highest key and value, and the mask of the values' buckets."""
    extra = [F.bit_or(buckets.bit(F.col(data))).alias("bitmap")] if buckets else []
    return paged.groupBy(page).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.min(data).alias("min_data"), F.max(data).alias("max_data"), *extra)


def live_pages(summary: DataFrame, min_key=None, max_key=None, min_data=None, max_data=None, buckets: Buckets | None = None) -> DataFrame:
    """The pages that may hold rows in the ranges; none that does is left out."""
    keep = F.lit(True)
    if min_key is not None:
        keep = keep & (F.col("max_key") >= min_key)
    if max_key is not None:
        keep = keep & (F.col("min_key") <= max_key)
    if min_data is not None:
        keep = keep & (F.col("max_data") >= min_data)
    if max_data is not None:
        keep = keep & (F.col("min_data") <= max_data)
    if buckets is not None and (min_data, max_data) != (None, None):
        keep = keep & overlaps(F.col("bitmap"), buckets.mask(min_data, max_data))
    return summary.where(keep)


def live_ranges(summary: DataFrame, page: str = "page_id", **bounds) -> list[tuple]:
    """At most RANGES ranges of keys that cover the live pages; pages follow each other as keys do, so each range takes a stretch of them."""
    live = live_pages(summary, **bounds)
    span = live.agg(F.min(page), F.max(page)).first()
    if span[0] is None:
        return []
    per = -(-(span[1] - span[0] + 1) // RANGES)
    stretch = F.expr(f"(`{page}` - {span[0]}) div {per}")
    rows = live.groupBy(stretch.alias("_tm_stretch")).agg(F.min("min_key").alias("low"), F.max("max_key").alias("high")).orderBy("low").collect()
    return [(r.low, r.high) for r in rows]


def pruned_scan(df: DataFrame, summary: DataFrame, key: str, data: str, min_key=None, max_key=None, min_data=None, max_data=None, buckets: Buckets | None = None, page: str = "page_id") -> DataFrame:
    """Rows in the ranges, read only where live pages are: their ranges of keys are filters that reach the table's own scan.

    The summary of a large table is a table of its own.
    """
    ranges = live_ranges(summary, page, min_key=min_key, max_key=max_key, min_data=min_data, max_data=max_data, buckets=buckets)
    where = F.lit(False)
    for low, high in ranges:
        where = where | in_range(key, low, high)
    rows = df.where(where).where(in_range(key, min_key, max_key) & in_range(data, min_data, max_data))
    if buckets is not None and (min_data, max_data) != (None, None):
        rows = rows.where(in_mask(F.col(data), buckets, buckets.mask(min_data, max_data)))
    return rows
