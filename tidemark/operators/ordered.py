"""Operations on the order of a whole table that no single task has to hold.

Rows are dealt into blocks of neighbouring keys, cut at quantiles of the key. Each block is ordered
on its own; what a block needs from those before it (their last row, highest value, sum or row
count) comes from a table with one row per block, of which there are at most MOST_BLOCKS.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK, MOST_BLOCKS, SHARES = 100_000, 4096, 64
BLOCK = "_tm_block"


def block_number(df: DataFrame, key: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column | None:
    """The block of a row; blocks follow each other as keys do. Nulls come before all keys. None if one block is enough."""
    many = min(MOST_BLOCKS, max(1, -(-df.count() // rows_per_block)))
    if many == 1:
        return None
    shares = [k / many for k in range(1, many)]
    cuts = sorted(set(df.agg(F.percentile_approx(F.col(key).cast("double"), shares, 100_000).alias("c")).first()["c"] or []))
    if not cuts:
        return None
    groups = [cuts[k : k + SHARES] for k in range(0, len(cuts), SHARES)]
    value = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    heads = F.array(*(F.lit(float(g[0])) for g in groups))
    table = F.array(*(F.array(*(F.lit(float(c)) for c in g)) for g in groups))
    group = F.greatest(F.size(F.filter(heads, lambda c: c <= value)), F.lit(1))
    return ((group - 1) * SHARES + F.size(F.filter(F.element_at(table, group), lambda c: c <= value))).cast("int")


class Ordered:
    """A table in the order of ``key``, then ``ties``; ``key`` is a number."""

    def __init__(self, df: DataFrame, key: str, ties: tuple[str, ...] = (), rows_per_block: int = ROWS_PER_BLOCK):
        self.key, self.ties = key, ties
        block = block_number(df, key, rows_per_block)
        self.single = block is None
        self._on(df.withColumn(BLOCK, F.lit(0) if self.single else block))

    def going_on(self, df: DataFrame) -> Ordered:
        """The same order and blocks for rows that came out of an operation with ``keep``."""
        other = copy.copy(self)
        other._on(df)
        return other

    def _on(self, df: DataFrame) -> None:
        self.df = df
        self.within = Window.partitionBy(BLOCK).orderBy(self.key, *self.ties)

    def _from_before(self, value: Column, combine) -> DataFrame:
        """One row per block: its number and ``combine`` over the values of all earlier blocks."""
        ring = Window.orderBy(BLOCK)  # at most MOST_BLOCKS rows
        each = self.df.groupBy(BLOCK).agg(value.alias("_tm_value"))
        return each.select(BLOCK, combine(ring).alias("_tm_before"))

    def _joined(self, df: DataFrame, before: DataFrame) -> DataFrame:
        if self.single:
            return df.withColumn("_tm_before", F.lit(None).cast(before.schema["_tm_before"].dataType))
        return df.join(F.broadcast(before), BLOCK, "left")

    def _done(self, df: DataFrame, keep: bool = False) -> DataFrame:
        return df.drop("_tm_before") if keep else df.drop(BLOCK, "_tm_before")

    def position(self, out: str) -> DataFrame:
        """Place in the whole order, from 0."""
        before = self._from_before(F.count(F.lit(1)), lambda w: F.sum("_tm_value").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        return self._done(self._joined(self.df, before).withColumn(out, (F.row_number().over(self.within) - 1 + F.coalesce("_tm_before", F.lit(0))).cast("long")))

    def previous(self, columns: dict[str, str], keep: bool = False) -> DataFrame:
        """New columns with values of the row before; of the first row, null. ``columns``: new name by old name. ``keep``: with the block."""
        old = list(columns)
        row = F.struct(*(F.col(c).alias(c) for c in old))
        last = F.max_by(row, F.struct(self.key, *self.ties))
        before = self._from_before(last, lambda w: F.lag("_tm_value").over(w))
        seen = self._joined(self.df, before).withColumn("_tm_prev", F.coalesce(F.lag(row).over(self.within), F.col("_tm_before")))
        for c in old:
            seen = seen.withColumn(columns[c], F.col("_tm_prev").getField(c))
        return self._done(seen, keep).drop("_tm_prev")

    def highest_before(self, column: str, out: str) -> DataFrame:
        """The highest value of all rows before; of the first row, null."""
        before = self._from_before(F.max(column), lambda w: F.max("_tm_value").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        own = F.max(column).over(self.within.rowsBetween(Window.unboundedPreceding, -1))
        return self._done(self._joined(self.df, before).withColumn(out, F.greatest(own, F.col("_tm_before"))))

    def running_sum(self, column: str, out: str) -> DataFrame:
        """The sum of all rows up to this one."""
        before = self._from_before(F.sum(column), lambda w: F.sum("_tm_value").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        own = F.sum(column).over(self.within.rowsBetween(Window.unboundedPreceding, 0))
        return self._done(self._joined(self.df, before).withColumn(out, (own + F.coalesce("_tm_before", F.lit(0))).cast("long")))
