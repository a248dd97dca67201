"""Many texts as one array of bytes, and hashes of words and windows of it, all as numpy operations.

A window's hash is a difference of running sums of per-byte random numbers times powers of an odd
base modulo 2**64, brought back to the window's start by the inverse power, then mixed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import keeps

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of ``x``."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


@lru_cache(maxsize=8)
def byte_numbers(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return mixed(np.arange(1, 257, dtype=U) * U(BASE) + U(seed))


class Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    def __init__(self):
        self.let_go()

    def let_go(self):
        self.up = self.down = np.ones(1, U)

    def of(self, n: int):
        if len(self.up) < n:
            n = -(-n // STEP) * STEP
            self.up = np.multiply.accumulate(np.r_[U(1), np.full(n - 1, BASE, U)])
            self.down = np.multiply.accumulate(np.r_[U(1), np.full(n - 1, INVERSE, U)])
        return self.up, self.down


#: Powers are worked out so many at a time.
STEP = 1 << 18
POWERS = Powers()
keeps("ragged", POWERS.let_go)


class Buffer:
    """The bytes of several texts one after the other, each followed by a line feed."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)

    def prefix(self, seed: int) -> np.ndarray:
        return prefix_of(self.data, seed)


def prefix_of(data: np.ndarray, seed: int) -> np.ndarray:
    """Running sums for window hashes, from 0 to the whole; a window's hash doesn't depend on where the data begin."""
    up, _ = POWERS.of(len(data) + 1)
    return np.r_[U(0), np.cumsum(byte_numbers(seed)[data] * up[: len(data)])]


def window_hash(prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the windows from ``first`` to before ``last``; windows of different lengths may collide only by chance."""
    down = POWERS.of(len(prefix))[1]
    return mixed((prefix[last] - prefix[first]) * down[first] + (last - first).astype(U) * U(0xA0761D6478BD642F))


def groups_of(values, sizes, limit: int):
    """Slices of ``values`` whose sizes sum to at most ``limit``, but for single larger ones."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(first, k)
            first, total = k, 0
        total += n
    if first < len(values):
        yield slice(first, len(values))


#: Bytes of words: letters, digits and everything beyond ASCII; letters count as small ones.
_WORD = np.zeros(256, bool)
for _r in ("az", "AZ", "09"):
    _WORD[ord(_r[0]) : ord(_r[1]) + 1] = True
_WORD[128:] = True
_SMALL = np.arange(256)
_SMALL[ord("A") : ord("Z") + 1] += 32


def words(buffer: Buffer, seed: int):
    """(hash of each word, text that it is in), in order."""
    data = buffer.data
    inside = _WORD[data]
    edge = np.diff(np.r_[False, inside, False].view(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, _ = POWERS.of(len(data) + 1)
    prefix = np.r_[U(0), np.cumsum(byte_numbers(seed)[_SMALL][data] * up[: len(data)])]
    return window_hash(prefix, first, last), np.searchsorted(buffer.starts, first, side="right") - 1


def shingles(buffer: Buffer, size: int, seed: int):
    """(hash of each run of ``size`` words within a text, the text); a text with fewer words has one run of them all."""
    word, text = words(buffer, seed)
    counts = np.bincount(text, minlength=len(buffer.lengths))
    starts = np.cumsum(counts) - counts
    salts = mixed(np.arange(1, size + 1, dtype=U) + U(seed))
    place = np.arange(len(word)) - starts[text]
    full = place + size <= counts[text]
    at = np.flatnonzero(full | (place == 0))
    total = np.zeros(len(at), U)
    for k in range(size):
        there = place[at] + k < counts[text[at]]
        nxt = np.minimum(at + k, max(0, len(word) - 1))
        total += np.where(there, mixed(word[nxt] + salts[k]), U(0)) if len(at) else total
    return mixed(total), text[at]
