"""Files of fixed-size pages of packed records, read and written.

A page is PAGE bytes: a header of HEADER bytes with the number of records as 16 bits at byte 4, then
records of an unsigned 32-bit key and three signed 32-bit numbers, little-endian.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the format
PAGE, HEADER, COUNT_AT = 512, 16, 4
RECORD = np.dtype([("key", "<u4"), ("a", "<i4"), ("b", "<i4"), ("c", "<i4")])
PER_PAGE = (PAGE - HEADER) // RECORD.itemsize


def unpacked(data: bytes) -> np.ndarray:
    """The records of whole pages; a part of a page at the end is left out."""
    pages = np.frombuffer(data[: len(data) // PAGE * PAGE], np.uint8).reshape(-1, PAGE)
    counts = pages[:, COUNT_AT : COUNT_AT + 2].copy().view("<u2").ravel()
    if (counts > PER_PAGE).any():
        raise ValueError(f"a page has no more than {PER_PAGE} records")
    records = np.ascontiguousarray(pages[:, HEADER : HEADER + PER_PAGE * RECORD.itemsize]).view(RECORD).reshape(len(pages), PER_PAGE)
    return records[np.arange(PER_PAGE)[None, :] < counts[:, None]]


def packed(rows: np.ndarray, first_page: int = 0) -> bytes:
    """Pages of records, full but for the last; numbers that don't fit a record's fields are refused."""
    for name in RECORD.names:
        held, x = np.iinfo(RECORD[name]), rows[name]
        if len(x) and (int(x.min()) < held.min or int(x.max()) > held.max):
            raise ValueError(f"{name} doesn't fit {RECORD[name].itemsize} bytes")
    out = bytearray()
    for k in range(0, len(rows), PER_PAGE):
        part = rows[k : k + PER_PAGE]
        head = np.zeros(HEADER, np.uint8)
        head[:4] = np.array([first_page + k // PER_PAGE], "<u4").view(np.uint8)
        head[COUNT_AT : COUNT_AT + 2] = np.array([len(part)], "<u2").view(np.uint8)
        out += head.tobytes() + part.astype(RECORD).tobytes() + bytes(PAGE - HEADER - len(part) * RECORD.itemsize)
    return bytes(out)


def read_pages(spark: SparkSession, path: str, names: tuple[str, str, str, str] = ("key", "a", "b", "c")) -> DataFrame:
    """The rows of a file, or of all files of a folder; each file is one task's."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                r = unpacked(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(r["key"].astype(np.int64)), *(pa.array(r[c]) for c in "abc")], names=list(names))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, f"`{names[0]}` long, `{names[1]}` int, `{names[2]}` int, `{names[3]}` int")


def write_pages(df: DataFrame, path: str) -> None:
    """Columns key, a, b, c in key order as page files, one for each range of keys, through Spark's file writer.

    Spark has no writer of raw bytes, so the files hold one binary row each in Parquet; ``read_packed`` takes them.
    """

    def run(batches):
        rows = [np.rec.fromarrays([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)], names="key,a,b,c") for b in batches]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([packed(np.concatenate(rows))], pa.binary())], names=["content"])

    df.select(*(F.col(c).cast("long") for c in ("key", "a", "b", "c"))).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "content binary").write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str, names: tuple[str, str, str, str] = ("key", "a", "b", "c")) -> DataFrame:
    """The rows of what ``write_pages`` wrote."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                r = unpacked(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(r["key"].astype(np.int64)), *(pa.array(r[c]) for c in "abc")], names=list(names))

    return spark.read.parquet(path).select("content").mapInArrow(run, f"`{names[0]}` long, `{names[1]}` int, `{names[2]}` int, `{names[3]}` int")
