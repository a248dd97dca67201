"""The thin queries of the corpus operators; their SQL is in oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .fingerprints import fingerprint_documents, within_radius
from .line_field import fit_quality, held_out, score_quality
from .near_dedup import near_duplicates
from .oracles import ORACLE_SQL  # noqa: F401
from .packing import pack_documents
from .piece_coding import DIGESTS, encode_documents
from .secrets import scan_secrets
from .sharding import shard_documents
from .suffix_dedup import count_repeats
from .token_counts import count_tokens
from .top_k import top_scores


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_scores(rows, rows.where("vec_id % 50 = 0"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), DIGESTS)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_within: for ids divisible by 100, how many documents' fingerprints differ in at most 3 bits, its own included."""
    rows = written(fingerprint_documents(table(spark, sf_dir, "documents")), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    found = within_radius(rows.where(asked), rows, radius=3)
    told = rows.where(asked).join(found, "fingerprint_bits", "left")
    return told.unionByName(rows.where(~asked).withColumn("n_within", F.lit(None).cast("long"))).drop("fingerprint_bits")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_top_k, op3_near_dedup, op4_piece_coding, op5_sharding, op6_secret_scan, op7_token_counts, op8_packing, op9_fingerprints, op10_suffix_dedup)}
