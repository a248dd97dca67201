"""Projection, selection and joins."""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import resolved

# fixed values: the numbers of the comparisons
GT, LT, GTE, LTE, EQ, NEQ = range(6)
COMPARISONS = {GT: operator.gt, LT: operator.lt, GTE: operator.ge, LTE: operator.le, EQ: operator.eq, NEQ: operator.ne}


def project(df: DataFrame, columns) -> DataFrame:
    """Columns by name or position, in the order given; one that comes again gets a number behind its name."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        name = resolved(df, c)
        again = seen.get(name, 0)
        seen[name] = again + 1
        out.append(F.col(name) if not again else F.col(name).alias(f"{name}_{again}"))
    return df.select(*out)


def select(df: DataFrame, column: int | str, comparison: int, constant) -> DataFrame:
    """Rows whose column compares with the constant; a comparison that isn't known keeps none."""
    compare = COMPARISONS.get(comparison)
    return df.where(compare(F.col(resolved(df, column)), F.lit(constant)) if compare else F.lit(False))


def shift_key(df: DataFrame, key: str, by: int) -> DataFrame:
    """Keys moved by a constant."""
    return df.withColumn(key, F.col(key) + F.lit(by))


def round_key(df: DataFrame, key: str, step: int) -> DataFrame:
    """Keys taken down to a multiple of ``step``."""
    return df.withColumn(key, F.col(key) - F.pmod(F.col(key), F.lit(step)))


def key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, suffix: str = "_r", duplicates: str = "all", left_order: str | None = None, right_order: str | None = None) -> DataFrame:
    """Inner join on the keys with all columns of both, the key twice; names of the right side that clash get a suffix.

    Keys are meant to be distinct. Where they aren't, ``duplicates`` decides: "all" pairs every row
    with every row of its key; "zip" pairs the n-th with the n-th by the orders given, as a merge
    that moves both sides on does. Zipping orders each key's rows in one task.
    """
    names = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns}
    right = right.select(*(F.col(c).alias(n) for c, n in names.items()))
    match = F.col(left_key) == F.col(names[right_key])
    if duplicates == "all":
        return left.join(right, match)
    if duplicates != "zip":
        raise ValueError("duplicates is all or zip")
    a = left.withColumn("_tm_l", F.row_number().over(Window.partitionBy(left_key).orderBy(left_order or left_key)))
    b = right.withColumn("_tm_r", F.row_number().over(Window.partitionBy(names[right_key]).orderBy(names[right_order or right_key])))
    return a.join(b, match & (F.col("_tm_l") == F.col("_tm_r"))).drop("_tm_l", "_tm_r")
