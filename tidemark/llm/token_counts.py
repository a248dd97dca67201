"""Token counts of whole texts by rank-synchronous array merging (see vocabulary.py).

Defined results: a null text counts as empty and has no tokens; a null id stays null; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .common import released, tokenizer_path, workers_can_import


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and whether n_tokens is above ``limit``, one row per row of ``docs``."""
    workers_can_import(docs.sparkSession)

    def run(batches):
        counter = vocabulary.counter(tokenizer_path(tokenizer))
        for batch in released(batches, "vocabulary"):
            texts = batch.column(1)
            sizes = pa.compute.binary_length(texts)
            counts = list(counter.counts(x.as_py() or "" for x in texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.cast(pa.int64()).fill_null(0)), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    counted = source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
