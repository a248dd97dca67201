"""A learned index from keys to pages: a greedy spline within an error corridor, and lookups by it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND = 1 << 64


class Spline:
    """Points (key, page); between neighbours a key's page is interpolated to within ``max_error``.

    With ``size`` the points are bounded: ``erase`` of the oldest go when it is full, as long as not
    just one would be left.
    """

    def __init__(self, max_error: int = 1, size: int | None = None, erase: int = 1):
        self.max_error, self.size, self.erase_count = max_error, size, erase
        self.points: list[tuple[int, int]] = []
        self.first: tuple[int, int] | None = None
        self._calls, self._open = 0, False
        self._key = self._page = 0
        self._low = self._high = (0, 0)

    def _corridor(self, key: int, page: int) -> None:
        self._low, self._high = (key, max(0, page - self.max_error)), (key, page + self.max_error)

    def _slopes(self, origin, point, unsigned: bool = False):
        rise = point[1] - origin[1]
        return (rise % (1 << 32) if unsigned else rise), point[0] - origin[0]

    @staticmethod
    def _above(a, b) -> bool:
        """Whether slope a is above slope b; a negative rise goes round and counts as very steep."""
        return (a[0] * b[1]) % ROUND > (b[0] * a[1]) % ROUND

    def add(self, key: int, page: int) -> None:
        """A page and its first key; keys that don't rise are skipped."""
        self._calls += 1
        if self._calls == 1:
            self.points, self.first, self._key = [(key, page)], (key, page), key
            return
        if self._calls == 2:
            self._corridor(key, page)
            self._page = page
        elif key <= self._key:
            return
        if self._open:
            self.points.pop()
        origin = self.points[-1]
        here, high, low = self._slopes(origin, (key, page)), self._slopes(origin, self._high), self._slopes(origin, self._low)
        self._make_room()
        if self._above(here, high) or self._above(low, here):
            self.points.append((self._key, self._page))
            self._corridor(key, page)
            self._make_room()
        else:
            if self._above(high, self._slopes(origin, (key, page + self.max_error), True)):
                self._high = (key, page + self.max_error)
            if self._above(self._slopes(origin, (key, max(0, page - self.max_error)), True), low):
                self._low = (key, max(0, page - self.max_error))
        self._key, self._page, self._open = key, page, True
        self.points.append((key, page))

    def _make_room(self) -> None:
        if self.size is not None and len(self.points) >= self.size:
            self.erase(self.erase_count)

    def erase(self, count: int) -> bool:
        """Drop the oldest points; refused if there are fewer or just one would be left."""
        if count > len(self.points) or len(self.points) - count == 1:
            return False
        del self.points[:count]
        return True

    def prune(self, first_page: int) -> int:
        """Drop points whose segments lie wholly before a page; at least two stay. Returns how many went."""
        gone = 0
        while len(self.points) - gone > 2 and self.points[gone + 1][1] < first_page:
            gone += 1
        del self.points[:gone]
        return gone

    def find(self, key: int) -> tuple[int, int, int]:
        """(likely page, least page, highest page) of a key."""
        if key < self.points[0][0] or len(self.points) == 1:
            low, high = self.first[1], self.points[0][1]
            return (low + high) // 2, low, high
        end = self.points[-1]
        if key > end[0]:
            return (end[1],) * 3
        k = next(i for i in range(1, len(self.points)) if self.points[i][0] >= key)
        (x0, y0), (x1, y1) = self.points[k - 1], self.points[k]
        page = (key - x0) * (y1 - y0) // (x1 - x0) + y0
        return page, max(0, page - self.max_error), min(page + self.max_error, end[1])


def build(summary: DataFrame, max_error: int = 1, size: int | None = None, erase: int = 1, page: str = "page_id", key: str = "min_key") -> Spline:
    """The spline of a page summary, streamed to the driver in key order, a partition at a time."""
    spline = Spline(max_error, size, erase)
    for row in summary.select(key, page).orderBy(key).toLocalIterator(prefetchPartitions=True):
        spline.add(row[0], row[1])
    return spline


def spline_points(spline: Spline, spark) -> DataFrame:
    return spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(spline.points)], "point_no long, key long, page_id long")


def _scaled(x: np.ndarray, by: np.ndarray, of: np.ndarray) -> np.ndarray:
    """x * by // of, exact also where the product goes beyond 64 bits."""
    large = np.flatnonzero(x.astype(np.float64) * by > 2.0**62)
    out = x * by // of
    out[large] = [int(a) * int(b) // int(c) for a, b, c in zip(x[large], by[large], of[large])]
    return out


def estimated(keys: DataFrame, key: str, spline: Spline) -> DataFrame:
    """``keys`` with loc, low and high by the spline, looked up many at a time."""
    xs, ys = np.array([p[0] for p in spline.points], np.int64), np.array([p[1] for p in spline.points], np.int64)
    first, error = spline.first, spline.max_error

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.clip(np.searchsorted(xs, x, side="left"), 1, max(1, len(xs) - 1))
            if len(xs) > 1:
                wide = np.maximum(xs[k] - xs[k - 1], 1)
                loc = _scaled(np.clip(x, xs[k - 1], xs[k]) - xs[k - 1], ys[k] - ys[k - 1], wide) + ys[k - 1]
            else:
                loc = np.full(len(x), ys[0])
            low, high = np.maximum(loc - error, 0), np.minimum(loc + error, ys[-1])
            before, after = (x < xs[0]) | (len(xs) == 1), (x > xs[-1]) & (len(xs) > 1)
            loc = np.where(before, (first[1] + ys[0]) // 2, np.where(after, ys[-1], loc))
            low, high = np.where(before, first[1], np.where(after, ys[-1], low)), np.where(before, ys[0], np.where(after, ys[-1], high))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(loc), pa.array(low), pa.array(high)], names=[*batch.schema.names, "loc", "low", "high"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    return keys.mapInArrow(run, f"{fields}, loc long, low long, high long")


def page_of(keys: DataFrame, key: str, summary: DataFrame, spline: Spline, reach: int = 1) -> DataFrame:
    """The page that holds each key, or null: pages from low to high are asked, widened by ``reach`` as a linear correction."""
    guessed = estimated(keys, key, spline)
    asked = guessed.withColumn("_tm_page", F.explode(F.sequence(F.greatest(F.col("low") - reach, F.lit(0)), F.col("high") + reach)))
    pages = summary.select(F.col("page_id").alias("_tm_page"), F.col("min_key").alias("_tm_low"), F.col("max_key").alias("_tm_high"))
    hit = asked.join(pages, "_tm_page", "left").withColumn("_tm_hit", F.when(_between(F.col(key), F.col("_tm_low"), F.col("_tm_high")), F.col("_tm_page")))
    return hit.groupBy(*keys.columns, "loc", "low", "high").agg(F.max("_tm_hit").alias("page_id"))


def _between(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value <= high)
