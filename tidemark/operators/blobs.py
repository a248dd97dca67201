"""Where binary values lie in their own pages, and which of them a ring of such pages has lost.

Each data page starts on a fresh blob page, so a data page's layout depends on its own values
alone: layouts are worked out for many data pages at a time, and page numbers follow from a running
sum over data pages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered
from .retention import first_live_page, first_reopened_page

#: Stands for no value, and for no row where a data page has fewer than others.
NO_ROW = -1


def layouts(lengths: np.ndarray, page_size: int, header: int):
    """(first, last) blob page of each value of many data pages, and the blob pages that each takes once the next one begins.

    ``lengths`` has a row for each data page; negative ones are no values. A value is a four-byte length
    and its bytes. It may run on over pages; its length may not. All data pages are worked on at once, value by value.
    """
    room = page_size - header
    page, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)  # ``at`` is counted from the header's end
    first, last = np.zeros(lengths.shape, np.int64), np.zeros(lengths.shape, np.int64)
    for k in range(lengths.shape[1]):
        n = lengths[:, k]
        full = at > room - 4
        page, at = page + full, np.where(full, 0, at)
        first[:, k] = page
        end = np.where(n < 0, at, at + 4 + n)
        page, at = page + end // room, end % room
        # a value that ends with its page has no bytes on the next one
        last[:, k] = np.where((n >= 0) & (at == 0) & (page > first[:, k]), page - 1, page)
    return first, last, page + (at > 0)


def layout(lengths, page_size: int, header: int) -> list[tuple[int, int]]:
    """``layouts`` of one data page."""
    first, last, _ = layouts(np.asarray(lengths, np.int64).reshape(1, -1), page_size, header)
    return list(zip(first[0].tolist(), last[0].tolist()))


def pages_used(lengths, page_size: int, header: int) -> int:
    return int(layouts(np.asarray(lengths, np.int64).reshape(1, -1), page_size, header)[2][0])


def blob_pages(paged: DataFrame, key: str, length: str, page_size: int, header: int, page: str = "page_id", pages_per_task: int = 512) -> DataFrame:
    """key, the data page, and the first and last blob page of each row's value; ``length`` is null for no value."""
    rows = paged.select(F.col(key).cast("long").alias("k"), F.col(page).cast("long").alias("p"), F.coalesce(F.col(length), F.lit(-1)).cast("long").alias("n"), F.expr(f"`{page}` div {pages_per_task}").alias("_task"))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["p", "k"], ignore_index=True)
        p, which, many = np.unique(rows["p"].to_numpy(), return_inverse=True, return_counts=True)
        spot = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        lengths = np.full((len(p), int(many.max(initial=0))), NO_ROW)
        lengths[which, spot] = rows["n"].to_numpy()
        first, last, _ = layouts(lengths, page_size, header)
        used = np.zeros(len(p), np.int64)
        for m in np.unique(many):  # pages with as many rows
            same = many == m
            used[same] = layouts(lengths[same, :m], page_size, header)[2]
        return pd.DataFrame({"k": rows["k"], "p": rows["p"], "a": first[which, spot], "b": last[which, spot], "used": used[which]})

    placed = rows.groupBy("_task").applyInPandas(place, "k long, p long, a long, b long, used long")
    # one row per data page, summed in order without a task over all of them
    each = placed.groupBy("p").agg(F.max("used").alias("used"))
    start = Ordered(each, "p").running_sum("used", "upto").select("p", (F.col("upto") - F.col("used")).alias("start"))
    return placed.join(start, "p").select(F.col("k").alias(key), F.col("p").alias(page), (F.col("a") + F.col("start")).alias("first_blob_page"), (F.col("b") + F.col("start")).alias("last_blob_page"))


def blob_pages_written(placed: DataFrame, flushed: bool = False) -> int:
    """Blob pages written so far: all but the one in hand, or all after a flush."""
    last = placed.agg(F.max("last_blob_page")).first()[0]
    return 0 if last is None else last + int(flushed)


def first_kept_key(placed: DataFrame, key: str, written: int, pages: int, block: int, reopened: bool) -> int | None:
    """The least key whose value is still there.

    While open: one above the highest key on the last erased page. After reopening: one above the
    highest key on the first page that is left, whose values are given up too.
    """
    first = first_reopened_page(written, pages, block) if reopened else first_live_page(written, pages, block)
    if first == 0:
        return placed.agg(F.min(key)).first()[0]
    page = first if reopened else first - 1
    on = placed.where((F.col("first_blob_page") <= page) & (F.col("last_blob_page") >= page))
    return on.agg(F.max(key)).first()[0] + 1


def with_blob_status(rows: DataFrame, key: str, blob: str, first_key: int) -> DataFrame:
    """``rows`` with a status (0 there or never given, 1 lost) and the value only where it is still there."""
    lost = F.col(blob).isNotNull() & (F.col(key) < F.lit(first_key))
    return rows.withColumn("blob_status", lost.cast("int")).withColumn(blob, F.when(~lost, F.col(blob)))
