"""Ingest: rows are taken only while their keys rise; appends, flushes and recovery of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .ordered import ROWS_PER_BLOCK, Ordered

ACCEPTED, REJECTED = 0, 1


def judged(arrivals: DataFrame, key: str, arrival: str, highest: int | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Arrivals with put_status: 0 if the key is above all that came before (and above ``highest``), else 1."""
    seen = Ordered(arrivals, arrival, (), rows_per_block).highest_before(key, "_tm_high")
    bar = F.greatest(F.col("_tm_high"), F.lit(highest).cast("long")) if highest is not None else F.col("_tm_high")
    return seen.withColumn("put_status", F.when(F.col(key).isNotNull() & (bar.isNull() | (F.col(key) > bar)), ACCEPTED).otherwise(REJECTED)).drop("_tm_high")


def accepted(arrivals: DataFrame, key: str, arrival: str, highest: int | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The arrivals that are stored, in a table of strictly rising keys."""
    return judged(arrivals, key, arrival, highest, rows_per_block).where(F.col("put_status") == ACCEPTED).drop("put_status")


class Table:
    """A stored table: a folder of Parquet files, sorted by key within each, with rows that wait to be written."""

    def __init__(self, spark: SparkSession, path: str, key: str, arrival: str, schema):
        self.spark, self.path, self.key, self.arrival, self.schema = spark, path, key, arrival, schema
        self.pending: DataFrame | None = None

    def stored(self) -> DataFrame:
        """What a reopened table has: whatever was flushed."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """What a reader sees, pending rows included, without a flush."""
        return self.stored() if self.pending is None else self.stored().unionByName(self.pending)

    def highest(self) -> int | None:
        return self.rows().agg(F.max(self.key)).first()[0]

    def put(self, arrivals: DataFrame) -> DataFrame:
        """Take what rises; returns all arrivals with their put_status."""
        seen = judged(arrivals, self.key, self.arrival, self.highest())
        new = seen.where(F.col("put_status") == ACCEPTED).select(*self.schema.names)
        self.pending = new if self.pending is None else self.pending.unionByName(new)
        return seen

    def flush(self) -> None:
        """Write pending rows; nothing happens without any."""
        if self.pending is not None:
            self.pending.repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("append").parquet(self.path)
            self.pending = None

    def reset(self) -> None:
        """Drop all rows."""
        self.pending = None
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)

    def stats(self) -> dict:
        """Files, rows and the range of keys."""
        row = self.stored().agg(F.count(F.lit(1)), F.min(self.key), F.max(self.key)).first()
        return {"files": len(self.stored().inputFiles()), "rows": row[0], "min_key": row[1], "max_key": row[2], "pending": self.pending is not None}
