"""External induced sorting of one shard's suffixes with common prefixes.

A suffix is of kind S if it is smaller than the next one, else L; a first S after an L is a seed.
Seeds are sorted by their stretches up to the next seed and, where stretches are equal, by recursion
on their names. From sorted seeds all L suffixes follow in rising order: each suffix that comes out
of a queue puts the one before it in, keyed by its character and the order of the one it comes
from. S suffixes follow in falling order from the L ones. Tuples carry the least common prefix
between the suffix that put them in and the one that last put one into the same bucket, so the
common prefix of neighbours is one more. Queues keep a bounded number of tuples in memory and
write sorted runs to disk beyond that.

This is the method that is named for repeated passages. It works on one shard in one process, and
needs many tuples for each byte: the README has its measured cost, and why the query finds
repeats by suffix_dedup.py.
"""

from __future__ import annotations

import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np

S, L = 1, 0


class DiskQueue:
    """A priority queue of tuples of ``width`` numbers, the smallest first; at most ``held`` of them are in memory, but for a block of each run."""

    READ = 512

    def __init__(self, width: int, folder: str, held: int):
        self.pack, self.folder, self.held = struct.Struct(f"<{width}q"), folder, held
        self.heap: list = []
        self.runs: list = []  # heads of runs: (tuple, run number)
        self.files: list = []
        self.written = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        f = tempfile.TemporaryFile(dir=self.folder)
        f.write(b"".join(self.pack.pack(*x) for x in self.heap))
        self.written += len(self.heap) * self.pack.size
        f.seek(0)
        self.heap = []
        self.files.append((f, iter(())))
        self._advance(len(self.files) - 1)

    def _advance(self, k: int) -> None:
        f, block = self.files[k]
        item = next(block, None)
        if item is None:
            data = f.read(self.READ * self.pack.size)
            if not data:
                f.close()
                return
            block = self.pack.iter_unpack(data)
            item = next(block)
            self.files[k] = (f, block)
        heapq.heappush(self.runs, (item, k))

    def head(self):
        """The smallest tuple, or None."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, k = heapq.heappop(self.runs)
            self._advance(k)
            return item
        return heapq.heappop(self.heap)


class _Prefixes:
    """Least common prefixes since the last push into each bucket."""

    def __init__(self, size: int):
        self.least = np.full(size, 1 << 40, np.int64)

    def seen(self, prefix: int) -> None:
        np.minimum(self.least, prefix, out=self.least)

    def taken(self, bucket: int) -> int:
        out = int(self.least[bucket])
        self.least[bucket] = 1 << 40
        return out


class InducedSorter:
    """Sorts the suffixes of a byte string; ``limit`` caps common prefixes, ``held`` the tuples in memory."""

    def __init__(self, folder: str | None = None, held: int = 1_000_000, limit: int = 200):
        self.folder, self.held, self.limit, self.written, self.tuples = folder, held, limit, 0, 0

    def _queue(self, width: int) -> DiskQueue:
        return DiskQueue(width, self.folder, self.held)

    def _done(self, queue: DiskQueue, pushed: int) -> None:
        self.written += queue.written
        self.tuples += pushed

    def suffixes(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, bytes shared with the suffix before, at most ``limit``) of all suffixes in rising order."""
        yield from self._sorted(np.frombuffer(text, np.uint8).tolist(), 256, text)

    def _shared(self, text: bytes, a: int, b: int) -> int:
        x, y = text[a : a + self.limit], text[b : b + self.limit]
        return len(os.path.commonprefix([x, y]))

    def _seeds(self, seq: list[int], kinds: bytearray) -> list[int]:
        """Seeds in rising order."""
        places = [i for i in range(1, len(seq)) if kinds[i] == S and kinds[i - 1] == L]
        ends = [*places[1:], len(seq) - 1] if places else []
        # of equal characters one of kind L is smaller; no stretch is the start of another one then
        stretches = sorted((tuple(2 * seq[k] + kinds[k] for k in range(a, b + 1)), a) for a, b in zip(places, ends))
        names, name, last = {}, -1, None
        for stretch, a in stretches:
            if stretch != last:
                name, last = name + 1, stretch
            names[a] = name
        if name + 1 == len(places):
            return [a for _, a in stretches]
        order = self._sorted([names[a] for a in places], name + 1, None)
        return [places[k] for k, _ in order]

    def _sorted(self, seq: list[int], size: int, text: bytes | None) -> Iterator[tuple[int, int]]:
        n = len(seq)
        if n < 2:
            return iter([(0, 0)] * n)
        kinds = bytearray(n)
        for i in range(n - 2, -1, -1):
            kinds[i] = S if seq[i] < seq[i + 1] or seq[i] == seq[i + 1] and kinds[i + 1] == S else L
        large = self._large(seq, size, text, self._seeds(seq, kinds))
        return self._small(seq, size, text, kinds, large)

    def _large(self, seq, size, text, seeds) -> list[tuple[int, int]]:
        """L suffixes in rising order, with what each shares with the L suffix before it."""
        queue, out, at, order, before = self._queue(4), [], 0, 0, None
        marks = _Prefixes(size) if text is not None else None
        n = len(seq)
        queue.push((seq[n - 1], -1, n - 1, 0))
        while (head := queue.head()) is not None or at < len(seeds):
            seed = head is None or at < len(seeds) and seq[seeds[at]] < head[0]
            if seed:
                i = seeds[at]
                at += 1
                prefix = self._shared(text, before, i) if text is not None and before is not None else 0
            else:
                c, _, i, carried = queue.pop()
                same = before is not None and seq[before] == c
                prefix = min(self.limit, carried + 1) if same else 0
                out.append((i, prefix))
            before = i
            if marks is not None:
                marks.seen(prefix)
            if i and seq[i - 1] >= seq[i]:
                queue.push((seq[i - 1], order, i - 1, min(marks.taken(seq[i - 1]), self.limit) if marks is not None else 0))
            order += 1
        self._done(queue, len(out))
        return out

    def _small(self, seq, size, text, kinds, large) -> Iterator[tuple[int, int]]:
        """All suffixes in rising order, from S suffixes put in in falling order."""
        queue, out, at, order, after = self._queue(4), [], len(large) - 1, 0, None
        marks, pushed = (_Prefixes(size) if text is not None else None), 0
        while (head := queue.head()) is not None or at >= 0:
            if head is None or at >= 0 and seq[large[at][0]] > -head[0]:
                i = large[at][0]
                # neighbours of a bucket's L suffixes know what they share; the last of them meets an S suffix
                if after is None or seq[after] != seq[i]:
                    prefix = 0
                elif at + 1 < len(large) and after == large[at + 1][0]:
                    prefix = large[at + 1][1]
                else:
                    prefix = self._shared(text, i, after) if text is not None else 0
                at -= 1
            else:
                c, _, i, carried = queue.pop()
                prefix = min(self.limit, carried + 1) if after is not None and seq[after] == -c else 0
            if out:
                out[-1] = (out[-1][0], prefix)
            out.append((i, 0))
            after = i
            if marks is not None:
                marks.seen(prefix)
            if i and kinds[i - 1] == S:
                queue.push((-seq[i - 1], order, i - 1, min(marks.taken(seq[i - 1]), self.limit) if marks is not None else 0))
                pushed += 1
            order += 1
        self._done(queue, pushed)
        return reversed(out)


def repeated_windows(texts: list[bytes], length: int, sorter: InducedSorter) -> list[np.ndarray]:
    """For each text a mask of the starts of windows of ``length`` bytes that start elsewhere too, in it or in another."""
    joined = b"\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(joined)]
    room = starts[owner + 1] - 1 - np.arange(len(joined)) >= length  # the window lies within its text
    hit = np.zeros(len(joined), bool)
    last = None  # the last suffix with room, and what it shares with the one at hand
    shared = 0
    for i, prefix in sorter.suffixes(joined):
        shared = min(shared, prefix)
        if room[i]:
            if last is not None and shared >= length:
                hit[[last, i]] = True
            last, shared = i, length
    return [hit[a : a + len(t)] for a, t in zip(starts, texts)]
