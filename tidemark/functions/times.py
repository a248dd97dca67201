"""Keys from timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{column}` as timestamp_ntz))")


def bucket(column: str, width: int) -> Column:
    """Integer division of a key, towards zero."""
    return F.expr(f"cast(`{column}` as bigint) div {int(width)}")
