"""Page files as a Spark data source: ``spark.read.format("tidemark_pages").load(folder)`` and ``df.write``.

One task reads one file. Equal, lower and upper bounds on the key that Spark pushes down skip pages
by their first and last keys, as pages hold rising keys. Paths are local or on a mounted shared
folder; ``page_file.read_pages`` reads from any store that Spark reads.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .page_file import COUNT_AT, HEADER, PAGE, RECORD, packed, unpacked

SCHEMA = "key long, a int, b int, c int"
FORMAT = "tidemark_pages"


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it take filters."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith(("_", ".")))


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], overwrite)


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path, 0, (1 << 32) - 1

    def pushFilters(self, filters):
        """Take bounds on the key; all others stay with Spark."""
        for f in filters:
            known = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("key",) and isinstance(f.value, int)
            if not known:
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))

    def partitions(self):
        return [InputPartition(f) for f in files_of(self.path)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            data = f.read()
        pages = np.frombuffer(data[: len(data) // PAGE * PAGE], np.uint8).reshape(-1, PAGE)
        if len(pages):
            counts = pages[:, COUNT_AT : COUNT_AT + 2].copy().view("<u2").ravel().astype(np.int64)
            first = pages[:, HEADER : HEADER + 4].copy().view("<u4").ravel()
            at = HEADER + (np.maximum(counts, 1) - 1) * RECORD.itemsize
            last = pages[np.arange(len(pages))[:, None], at[:, None] + np.arange(4)].copy().view("<u4").ravel()
            pages = pages[(counts > 0) & (first <= self.high) & (last >= self.low)]
        rows = unpacked(pages.tobytes())
        rows = rows[(rows["key"] >= self.low) & (rows["key"] <= self.high)]
        yield pa.RecordBatch.from_arrays([pa.array(rows["key"].astype(np.int64)), *(pa.array(rows[c]) for c in "abc")], names=["key", "a", "b", "c"])


class PageWriter(DataSourceArrowWriter):
    """A file per task, written under another name until the job commits."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://").removeprefix("file:"), overwrite
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches):
        rows = [np.rec.fromarrays([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)], names="key,a,b,c") for b in batches]
        name = os.path.join(self.path, f"_{uuid.uuid4().hex}.pages")
        with open(name, "wb") as f:
            f.write(packed(np.concatenate(rows)) if rows else b"")
        return _Written(name)

    def commit(self, messages):
        old = files_of(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                folder, name = os.path.split(m.name)
                os.replace(m.name, os.path.join(folder, name[1:]))
        for f in old:  # only once the new ones are there
            os.remove(f)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name
