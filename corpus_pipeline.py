"""From raw documents to packed token sequences, stage by stage.

Each stage is written as Parquet and read again by the next one: lost executors cost a stage at
most, and no plan grows over the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_tables, table, tables_so_far, written
from tidemark.llm.line_field import fit_quality, keep_good
from tidemark.llm.near_dedup import drop_near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.secrets import redact_secrets
from tidemark.llm.suffix_dedup import remove_repeats


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good ones."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that come more than once."""
    return _measured(remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    return _measured(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, packed into sequences."""
    return pack_documents(docs, with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("secrets", secrets), ("packing", packing)]

#: No stage but the last could be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    docs = table(spark, sf_dir, "documents")
    since = tables_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_tables(spark, since, keep=1)  # what the stage and the ones before it have left, but for its result
    return STAGES[-1][1](spark, docs, sf_dir)
