"""Helpers shared by the corpus operators: input tables, shared scratch tables, gapless numbering."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of a batch for a Python worker, where the session has Spark's default; a longer text is a batch of its own.
BATCH_BYTES, SPARK_BYTES = "4194304b", "67108864b"
#: Bits of a membership bitmap for each key, and of a whole one at most (16 MB).
BITS, MOST_BITS, PER_BITMAP = 16, 1 << 27, 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the files are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def workers_can_import(spark: SparkSession) -> None:
    """Put this package on the Python workers' path (a cluster without this folder gets it by --py-files), and bound their batches."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", SPARK_BYTES) == SPARK_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_tidemark_scratch", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext._tidemark_scratch = root
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_seen(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates of its rows (their number is ``n``) that the job of the writing itself works out."""
    seen = Observation()
    df = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *(m.alias(k) for k, m in measures.items())), name)
    return df, seen.get


def _tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that this session has written and not yet dropped."""
    context = spark.sparkContext
    if not hasattr(context, "_tidemark_tables"):
        context._tidemark_tables = []
    return context._tidemark_tables


def tables_so_far(spark: SparkSession) -> int:
    return len(_tables(spark))


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Drop scratch tables written since there were ``since`` of them, but for the last ``keep``; results that still read them must be done."""
    tables = _tables(spark)
    gone = tables[since : len(tables) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    tables[since : len(tables) - keep] = []


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Number the rows of each key from 0 without gaps, no task holding a whole key.

    Rows of a key are dealt to ``buckets`` by a hash of ``order``; each bucket is numbered on its
    own and shifted by the counts of the buckets before it. ``df`` must give the same rows each
    time it is computed; rows that tie in ``order`` get any of the tied numbers.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*keys, "_b").count().withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return dealt.withColumn("_rn", rank).join(shift, [*keys, "_b"]).withColumn(out, (F.col("_rn") + F.col("_off")).cast("long")).drop("_b", "_rn", "_off")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def digest128(text: Column) -> Column:
    """16 bytes of a text's SHA-256: equal for equal texts only."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def among(rows: DataFrame, key: Column, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in the one column of ``keys`` (``n`` rows); none that is goes.

    Keys set bits of a bitmap that is broadcast, at most MOST_BITS in all. With so many keys that it
    would be no sieve, all rows stay.
    """
    bits = max(PER_BITMAP, -(-BITS * n // PER_BITMAP) * PER_BITMAP)
    if bits > MOST_BITS:
        return rows
    spot = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits))
    maps = keys.select(spot.alias("s")).groupBy(F.expr(f"s div {PER_BITMAP}").alias("_tm_map")).agg(F.expr(f"bitmap_construct_agg(s % {PER_BITMAP})").alias("_tm_bits"))
    place = rows.withColumn("_tm_spot", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("_tm_map", F.expr(f"_tm_spot div {PER_BITMAP}"))
    byte = F.conv(F.hex(F.expr(f"substring(_tm_bits, cast(_tm_spot % {PER_BITMAP} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = place.join(F.broadcast(maps), "_tm_map").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_tm_spot % 8 as int))")) != 0)
    return hit.select(*rows.columns)


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


#: Tables that a worker keeps from task to task, by their user: what lets go of them.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(user: str, let_go: Callable[[], None]) -> None:
    _KEPT[user] = let_go


def released(batches, user: str = ""):
    """The batches, memory of those that are done going back to the system after each; first this worker lets go of what it keeps for others than ``user``."""
    import pyarrow as pa

    for other, let_go in _KEPT.items():
        if other != user:
            let_go()
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        _trim()(0)
