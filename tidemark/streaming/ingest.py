"""Streams: guarded appends, and windows over event time."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.ingest import accepted


def guarded_append(stream: DataFrame, path: str, key: str, arrival: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append what rises, micro-batch by micro-batch, to a Parquet table.

    Each batch overwrites its own folders, so one that runs again after a failure leaves the same
    rows. The highest key so far is one row beside each batch, in a folder that readers of the table
    skip; the checkpoint names the batch to go on with. Streams with another checkpoint write folders
    of their own, and their first batch starts from the highest key that the table holds by then.
    """
    run = f"run={zlib.crc32(checkpoint.encode()):08x}"

    def held(spark) -> int | None:
        try:
            rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
        except AnalysisException:
            return None
        return rows.where(~F.input_file_name().contains(f"/{run}/")).agg(F.max(F.col(key).cast("long"))).first()[0]

    def take(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"{path}/_high/{run}/batch="
        highest = spark.read.parquet(f"{mark}{number - 1}").first()[0] if number else held(spark)
        own = f"{path}/{run}/batch={number}"
        accepted(batch, key, arrival, highest).write.mode("overwrite").parquet(own)
        top = spark.read.schema(batch.schema).parquet(own).agg(F.greatest(F.max(F.col(key).cast("long")), F.lit(highest).cast("long")).alias("high"))
        top.write.mode("overwrite").parquet(f"{mark}{number}")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(df: DataFrame, time: str, width: str, aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Fixed windows of event time; a stream drops rows later than ``late``."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    grouped = rows.groupBy(F.window(time, width).alias("w")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return grouped.select(F.col("w.start").alias("window_start"), *aggregates)


def session_windows(df: DataFrame, time: str, gap: str, aggregates: dict[str, Column], keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Windows that go on while rows follow within ``gap``."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)
