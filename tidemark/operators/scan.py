"""Scans, range iteration, lookups and binary values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import resolved

FOUND, MISSING, EXPIRED = 0, -1, 1


def table_scan(df: DataFrame, columns=None, ordered_by: str | None = None) -> DataFrame:
    """All rows; at least two columns, the first of them an integer key. Rows come in key order only if that is asked for."""
    out = df.select(*(columns or df.columns))
    if len(out.columns) < 2:
        raise ValueError("a table has a key and at least one more column")
    if not isinstance(out.schema[0].dataType, (T.IntegralType, T.DecimalType)):
        raise ValueError("the first column is an integer key")
    return out.orderBy(ordered_by) if ordered_by else out


def in_range(column: str | Column, low=None, high=None) -> Column:
    """Inclusive bounds; an open side is None."""
    value = F.col(column) if isinstance(column, str) else column
    out = F.lit(True)
    if low is not None:
        out = out & (value >= low)
    if high is not None:
        out = out & (value <= high)
    return out


def range_scan(df: DataFrame, key: str, min_key=None, max_key=None, data: str | None = None, min_data=None, max_data=None) -> DataFrame:
    """Rows whose key and value lie in inclusive ranges. The value column is the first after the key unless named."""
    out = df.where(in_range(key, min_key, max_key)) if (min_key, max_key) != (None, None) else df
    if (min_data, max_data) != (None, None):
        out = out.where(in_range(data or resolved(df, 1), min_data, max_data))
    return out


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def get_many(df: DataFrame, key: str, keys: DataFrame, wanted: str, expired: Column | None = None) -> DataFrame:
    """One row per wanted key: the table's columns (null where missing) and a status: 0 found, -1 missing, 1 found without its blob."""
    hit = df.withColumn("_tm_hit", F.lit(1)).withColumn("_tm_old", expired if expired is not None else F.lit(False))
    joined = keys.select(F.col(wanted).alias("_tm_key")).join(hit, F.col("_tm_key") == F.col(key), "left")
    status = F.when(F.col("_tm_hit").isNull(), MISSING).when(F.col("_tm_old"), EXPIRED).otherwise(FOUND)
    rest = [c for c in df.columns if c != key]
    return joined.select(F.col("_tm_key").alias(wanted), *rest, status.cast("int").alias("status"))


def with_pending(stored: DataFrame, pending: DataFrame) -> DataFrame:
    """What a reader sees: stored rows and those not yet written."""
    return stored.unionByName(pending)


def blob_chunks(df: DataFrame, key: str, blob: str, size: int) -> DataFrame:
    """Each binary value in pieces: key, chunk number from 0, the chunk. Null and empty values have none."""
    data = F.col(blob).cast("binary")
    starts = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(size)))
    parts = df.select(key, data.alias("_tm_blob"), F.posexplode(starts).alias("chunk_no", "_tm_at"))
    return parts.select(key, "chunk_no", F.substring("_tm_blob", F.col("_tm_at"), F.lit(size)).alias("chunk"))


def observed(df: DataFrame, key: str) -> tuple[DataFrame, Observation]:
    """``df`` and what an action over it will have seen: rows, least and highest key."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key")), seen
