"""Schemas from column widths, and columns by name or position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def type_of_width(width: int) -> T.DataType:
    """The Spark type that holds all values of a column of so many bytes; negative widths are signed ones."""
    size = abs(width)
    if size == 0 or size > 127:
        raise ValueError("a column has 1 to 127 bytes")
    if size > 8:
        return T.BinaryType()
    steps = [(1, T.ByteType()), (2, T.ShortType()), (4, T.IntegerType()), (8, T.LongType())]
    if width < 0:
        return next(t for limit, t in steps if size <= limit)
    wider = [(1, T.ShortType()), (2, T.IntegerType()), (4, T.LongType()), (7, T.LongType()), (8, T.DecimalType(20, 0))]
    return next(t for limit, t in wider if size <= limit)


def schema_of(names, widths) -> T.StructType:
    """Named fields of the given widths; each keeps its width as metadata. Nothing is nullable, as the store has no nulls."""
    if len(names) != len(widths):
        raise ValueError("a width is needed for each column")
    return T.StructType([T.StructField(n, type_of_width(w), False, {"width": w}) for n, w in zip(names, widths)])


def width_of(schema: T.StructType) -> int:
    """Bytes of a record."""
    return sum(abs(f.metadata.get("width", 8)) for f in schema.fields)


def offset_of(schema: T.StructType, column: int) -> int:
    """Bytes before a column in a record."""
    return sum(abs(f.metadata.get("width", 8)) for f in schema.fields[:column])


def resolved(df: DataFrame, column: int | str) -> str:
    """A column's name, from its name or its position from 0."""
    if isinstance(column, int):
        if not 0 <= column < len(df.columns):
            raise ValueError(f"there is no column {column}")
        return df.columns[column]
    if column not in df.columns:
        raise ValueError(f"there is no column {column}")
    return column
