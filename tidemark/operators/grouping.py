"""Aggregation by keys, by runs of neighbouring rows, by sessions and of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ROWS_PER_BLOCK, Ordered


def group_by(df: DataFrame, keys: dict[str, Column], aggregates: dict[str, Column], show_keys: bool = False) -> DataFrame:
    """Groups of equal keys; only the aggregates come out unless the keys are asked for. An empty table gives no rows."""
    names = {k: f"_tm_{k}" for k in keys}
    out = df.groupBy(*(c.alias(names[k]) for k, c in keys.items())).agg(*(a.alias(n) for n, a in aggregates.items()))
    shown = [F.col(names[k]).alias(k) for k in keys] if show_keys else []
    return out.select(*shown, *aggregates)


def aggregate_all(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """One row for the whole table; none for an empty one."""
    return group_by(df, {"all": F.lit(1)}, aggregates)


def group_runs(df: DataFrame, key: str, same_group: Callable[[Callable[[str], Column]], Column], uses: list[str], aggregates: dict[str, Column], ties: tuple[str, ...] = (), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Groups of neighbouring rows in key order.

    ``same_group`` gets a function from a column's name to that column of the row before and tells
    whether a row goes on with the group; ``uses`` names the columns that it asks for. Runs are
    numbered without a single task over all rows, then grouped; partial sums keep long runs apart.
    """
    before = {c: f"_tm_before_{c}" for c in uses}
    ordered = Ordered(df, key, ties, rows_per_block)
    marked = ordered.previous({**{key: "_tm_before_key"}, **{c: n for c, n in before.items() if c != key}}, keep=True)
    old = {key: "_tm_before_key", **{c: n for c, n in before.items() if c != key}}
    goes_on = same_group(lambda name: F.col(old[name]))
    # the first row has no row before it
    marked = marked.withColumn("_tm_new", F.when(F.col("_tm_before_key").isNotNull() & F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).drop(*old.values())
    runs = ordered.going_on(marked).running_sum("_tm_new", "_tm_run")
    return runs.groupBy("_tm_run").agg(*(a.alias(n) for n, a in aggregates.items())).drop("_tm_run")


def sessions(df: DataFrame, key: str, gap: int, aggregates: dict[str, Column], rows_per_block: int = ROWS_PER_BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """Groups of rows of which none is more than ``gap`` after the one before."""
    return group_runs(df, key, lambda before: F.col(key) - before(key) <= gap, [key], aggregates, ties, rows_per_block)
