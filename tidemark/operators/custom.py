"""Operators and aggregates that users bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import group_runs
from .ordered import ROWS_PER_BLOCK


def apply_operator(df: DataFrame, operator: Callable[..., DataFrame], *args, **named) -> DataFrame:
    """An operator made of DataFrame operations."""
    return df.transform(operator, *args, **named)


def apply_rows(df: DataFrame, step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """An operator over batches of rows, with a state for each partition."""
    return df.mapInPandas(step, schema)


def aggregate_with(reset: Callable[[], object], add: Callable[[object, object], object], compute: Callable[[object], object], kind: str, column: str | Column) -> Column:
    """An aggregate from three functions: a fresh state, a state with one more value, the result.

    It takes a group's values in one task, as its functions can't merge states.
    """

    def run(values: pd.Series) -> object:
        state = reset()
        for v in values:
            state = add(state, v)
        return compute(state)

    run.__annotations__ = {"values": pd.Series, "return": {"double": float, "long": int, "string": str}[kind]}
    return F.pandas_udf(run, kind)(column)


def runs_with(df: DataFrame, key: str, same_group, uses: list[str], aggregates: dict[str, Column], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Groups by a user's predicate on a row and the row before."""
    return group_runs(df, key, same_group, uses, aggregates, (), rows_per_block)
