"""Bucket numbers of values and bit masks of buckets; bucket b is bit b."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the upper cuts of the eight buckets, the bases and steps of the sixteen and sixty-four
CUTS_8 = (10, 20, 30, 40, 50, 60, 100)
BASE = 320
STEP_16, STEP_64 = 30, 10


@dataclass(frozen=True)
class Buckets:
    """A classifier: the bucket of a value as a column and as a number."""

    count: int
    cuts: tuple[int, ...] = ()
    base: int = 0
    step: int = 0

    def column(self, value: Column) -> Column:
        if self.cuts:
            out = F.lit(len(self.cuts))
            for k in range(len(self.cuts) - 1, -1, -1):
                out = F.when(value < self.cuts[k], F.lit(k)).otherwise(out)
            return out.cast("int")
        place = F.ceil((value - F.lit(self.base)) / F.lit(self.step))
        return F.least(F.greatest(place, F.lit(0)), F.lit(self.count - 1)).cast("int")

    def number(self, value: float) -> int:
        if self.cuts:
            return sum(value >= c for c in self.cuts)
        return int(min(max(-((self.base - value) // self.step) if value != self.base else 0, 0), self.count - 1))

    def bit(self, value: Column) -> Column:
        one = F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(self.count)))
        return F.get(one, self.column(value))

    def mask(self, low: float | None = None, high: float | None = None) -> int:
        """The bits of all buckets that a range touches, as a signed 64-bit number; an open side reaches to the end."""
        first = 0 if low is None else self.number(low)
        last = self.count - 1 if high is None else self.number(high)
        bits = sum(1 << k for k in range(first, last + 1))
        return bits - (1 << 64) if bits >> 63 else bits


BUCKETS_8 = Buckets(8, cuts=CUTS_8)
BUCKETS_16 = Buckets(16, base=BASE, step=STEP_16)
BUCKETS_64 = Buckets(64, base=BASE, step=STEP_64)


def overlaps(a: Column, b: Column | int) -> Column:
    """Whether two masks share a bit."""
    return a.bitwiseAND(F.lit(b).cast("long") if isinstance(b, int) else b) != 0


def in_mask(value: Column, buckets: Buckets, mask: Column | int) -> Column:
    """Whether a value's bucket is in a mask."""
    return overlaps(buckets.bit(value), mask)
