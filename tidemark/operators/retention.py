"""Which pages of a ring of erase blocks are still there: while writing, after reopening, and with a log of single records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pages_written(rows: int, per_page: int, flushed: bool = False) -> int:
    """A full page is written when the next record comes; a flush writes what there is."""
    if flushed:
        return -(-rows // per_page)
    return max(0, (rows - 1) // per_page)


def first_live_page(written: int, pages: int, block: int) -> int:
    """The least page that isn't erased while the table is open."""
    return 0 if written <= pages else -(-(written - pages) // block) * block


def first_reopened_page(written: int, pages: int, block: int) -> int:
    """The least page after reopening, which goes on to the next block boundary."""
    if written <= pages:
        return 0
    return written - pages if written % pages == 0 else written - pages + block - written % block


def first_logged_page(written: int, pages: int, block: int) -> int:
    """The least page where two blocks are set aside for single records."""
    at = written // block * block
    return at - (pages - 2 * block) + block if at >= pages - 2 * block else 0


def free_pages(first: int, written: int, pages: int, block: int, logged: bool = False) -> int:
    return pages + first - written - (2 * block if logged else 0)


def retained(paged: DataFrame, first: int, page: str = "page_id") -> DataFrame:
    """Rows of pages that are still there."""
    return paged.where(F.col(page) >= F.lit(first))
