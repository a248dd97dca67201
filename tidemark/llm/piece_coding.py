"""SentencePiece encoding and decoding of a column of whole texts (see pieces.py).

Defined results: a null text counts as empty and has the end id alone; a null id stays null;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import released, tokenizer_path, workers_can_import

TYPES = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "spans_crc32": pa.int64(), "ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "decoded": pa.string()}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32")


def encode_documents(docs: DataFrame, outputs=("ids", "starts", "ends", "decoded"), tokenizer: str = "piece_bpe_32k.model", end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and, by ``outputs``, ids, byte spans of the source text, the decoded text or digests of them.

    The end id has no span. ``spans_crc32`` is that of all starts, then all ends, as 64-bit numbers.
    """
    workers_can_import(docs.sparkSession)

    def row(model, text: str) -> list:
        e = model.encode(text)
        decimal = " ".join(x for x in (e.decimal, str(model.end_id) if end else "") if x)
        made = {
            "n_tokens": lambda: len(e.ids) + int(end),
            "ids_sha256": lambda: hashlib.sha256(decimal.encode()).hexdigest(),
            "decoded_sha256": lambda: hashlib.sha256(e.decoded.encode("utf-8")).hexdigest(),
            "spans_crc32": lambda: zlib.crc32(e.ends.astype("<i8").tobytes(), zlib.crc32(e.starts.astype("<i8").tobytes())),
            "ids": lambda: np.append(e.ids, np.int32(model.end_id)) if end else e.ids,
            "starts": lambda: e.starts,
            "ends": lambda: e.ends,
            "decoded": lambda: e.decoded,
        }
        return [made[o]() for o in outputs]

    def run(batches):
        model = pieces.model(tokenizer_path(tokenizer))
        for batch in released(batches):
            columns = list(zip(*(row(model, t.as_py() or "") for t in batch.column(1)))) or [()] * len(outputs)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, TYPES[o]) for o, c in zip(outputs, columns))], names=[id_col, *outputs])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    spark_types = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, " + ", ".join(f"{o} {spark_types[TYPES[o]]}" for o in outputs))
