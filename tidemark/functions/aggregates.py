"""The aggregates of the engine as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count() -> Column:
    return F.count(F.lit(1))


def total(column: str | Column, wrap: bool = False) -> Column:
    """A 64-bit sum. It raises on overflow; with ``wrap`` it goes round as 64-bit arithmetic does."""
    value = F.col(column) if isinstance(column, str) else column
    if not wrap:
        return F.sum(value.cast("long"))
    half, whole = F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    return (F.pmod(F.sum(value.cast("decimal(28,0)")).cast("decimal(38,0)") + half, whole) - half).cast("long")


def least(column: str | Column) -> Column:
    return F.min(column)


def most(column: str | Column) -> Column:
    return F.max(column)


def mean(column: str | Column, size: int = 8) -> Column:
    """An average in double precision, or in single precision where ``size`` is below 5 (sum and count are divided as floats)."""
    value = F.col(column) if isinstance(column, str) else column
    if size > 4:
        return F.avg(value)
    return (F.sum(value).cast("float") / F.count(value).cast("float")).cast("float")


def last(column: str | Column, order: str | Column) -> Column:
    """The value of the group's last record."""
    return F.max_by(column, order)
