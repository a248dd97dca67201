"""Consistent samples of weighted shingles, and their weighted Jaccard similarity.

A shingle of five words weighs its count in the document times its inverse document frequency,
1 + ln(documents / frequency) / ln(documents): 2 for a shingle of one document, 1 for one of all, the same at any
size for frequencies that are the same power of it. (With the plain logarithm a large group of near copies makes
its own shingles so light that its few edits outweigh them, and falls apart.) Document frequencies come from a
count sketch of fixed size over all documents: a shingle's is the smaller of its two counters. A counter is too
high by the shingles that share it, on average all of them divided by WIDTH: with 500 a document, by one
frequency in 2000 documents. All frequencies above that are told apart, and all of them exactly on small tables.

Samples follow weights exactly, in all SAMPLES bins: each occurrence of a shingle in a document (its first, second, ...) has
its own stream of random times, at a rate of the shingle's inverse document frequency, and each
time falls into a random bin; a bin's sample is its first time. Streams depend on shingle and
occurrence only, so two documents share a bin's sample with a chance of their weighted Jaccard
similarity, bin by bin on its own, however few shingles hold the weight. Times are drawn as far as all bins are
filled, about SAMPLES (ln SAMPLES + 2) of them and one for each occurrence, not one per occurrence and sample.
"""

from __future__ import annotations

import numpy as np

from .ragged import U, Buffer, groups_of, mixed, shingles

SIZE, SEED = 5, 0x5EED
BANDS, BAND_SIZE = 24, 5
SAMPLES = BANDS * BAND_SIZE
#: Counters of a row of the sketch, and rows.
WIDTH, ROWS = 1 << 20, 2
DOC_BITS = 12
GROUP_BYTES = 1_000_000
#: Documents that are sampled at once; cells of a matrix of counts.
SAMPLED, CELLS = 512, 1 << 21


def document_shingles(texts: list[bytes]):
    """(shingle, its count in the document, document) for each document's different shingles, in order of documents; at most 2**12 texts."""
    hashes, doc = shingles(Buffer(texts), SIZE, SEED)
    keys = np.sort((doc.astype(U) << U(64 - DOC_BITS)) | (hashes >> U(DOC_BITS)))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    return keys & U((1 << (64 - DOC_BITS)) - 1), counts, (keys >> U(64 - DOC_BITS)).astype(np.int64)


def slots(shingle: np.ndarray) -> list[np.ndarray]:
    """The counter of each shingle in each row."""
    spread = mixed(shingle + U(0x51CE))
    return [((spread >> U(20 * r)) & U(WIDTH - 1)).astype(np.int64) for r in range(ROWS)]


class Frequencies:
    """Inverse document frequencies from the finished sketch."""

    def __init__(self, counters: np.ndarray, documents: int):
        share = np.log(np.maximum(counters, 1.0)) / np.log(max(documents, 2))
        self.table = np.maximum(2.0 - share, 1.0).astype(np.float32)

    def of(self, shingle: np.ndarray) -> np.ndarray:
        # the smaller counter has the larger inverse frequency
        return np.maximum.reduce([self.table[r][s] for r, s in enumerate(slots(shingle))]).astype(np.float64)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def samples(shingle, weight, doc, documents: int, count=None):
    """The sample of each document and bin; of a document without shingles, zeros. ``weight`` is that of all ``count``
    occurrences (one each, if not given); a shingle's weight for one occurrence is the same in all documents."""
    count = np.ones(len(shingle), np.int64) if count is None else count
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    stream = mixed(np.repeat(shingle, count) + level.astype(U) * U(0xA0761D6478BD642F))
    owner, rate = np.repeat(doc, count), np.repeat(weight / count, count)
    total = np.bincount(doc, weights=weight, minlength=documents)
    until = SAMPLES * (np.log(SAMPLES) + 2) / np.maximum(total, 1e-300)
    best, taken = np.full(documents * SAMPLES, np.inf), np.zeros(documents * SAMPLES, U)
    turn, time = np.zeros(len(stream), np.int64), np.zeros(len(stream))  # of each stream's last time so far
    while len(stream):
        on = np.arange(len(stream))
        while len(on):
            many = 1 + (rate[on] * (until[owner[on]] - time[on])).astype(np.int64)
            ends = np.cumsum(many)
            which, step = np.repeat(on, many), np.arange(ends[-1]) - np.repeat(ends - many, many)
            drawn = mixed(stream[which] + (turn[which] + step).astype(U) * U(0x9E3779B97F4A7C15))
            passed = np.cumsum(-np.log(_uniform(drawn)) / rate[which])
            at = time[which] + passed - np.repeat(np.r_[0.0, passed[ends[:-1] - 1]], many)
            soon = np.flatnonzero(at <= until[owner[which]])
            cell = owner[which[soon]] * SAMPLES + ((drawn[soon] & U(0xFFF)) % U(SAMPLES)).astype(np.int64)
            np.minimum.at(best, cell, at[soon])
            won = at[soon] == best[cell]
            taken[cell[won]] = mixed(drawn[soon[won]])
            # a stream whose last time is still within goes on; the others wait before their first time beyond
            within = np.bincount(which[soon], minlength=len(stream))[on]
            full = within == many
            last = ends - many + within - 1
            time[on] = np.where(within > 0, at[last], time[on])
            turn[on] += within
            on = on[full]
        short = ~np.isfinite(best.reshape(documents, SAMPLES)).all(axis=1)
        until = np.where(short, 1.5 * until, until)
        more = short[owner]
        stream, owner, rate, turn, time = stream[more], owner[more], rate[more], turn[more], time[more]
    return taken.reshape(documents, SAMPLES)


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One key per document and band, a hash of the band's samples."""
    parts = sample.reshape(len(sample), BANDS, BAND_SIZE)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15), parts.shape[:2])
    for k in range(BAND_SIZE):
        key = mixed(key ^ parts[:, :, k])
    return key.view(np.int64) if key.flags["C_CONTIGUOUS"] else key.copy().view(np.int64)


def signatures(texts: list[bytes], frequencies: Frequencies):
    """(band keys, number of different shingles, sum of their weights) of the texts, group by group in order."""
    for part in groups_of(texts, map(len, texts), GROUP_BYTES):
        for first in range(part.start, part.stop, SAMPLED):
            some = texts[first : min(part.stop, first + SAMPLED)]
            shingle, count, doc = document_shingles(some)
            weight = count * frequencies.of(shingle)
            sample = samples(shingle, weight, doc, len(some), count)
            yield band_keys(sample), np.bincount(doc, minlength=len(some)), np.bincount(doc, weights=weight, minlength=len(some))


class Weights:
    """Sorted shingles and weights of one text."""

    def __init__(self, text: bytes, frequencies: Frequencies):
        self.shingle, self.count, _ = document_shingles([text])
        self.weight = self.count * frequencies.of(self.shingle)
        self.total = float(self.weight.sum())

    def likeness(self, other: Weights) -> float:
        """Sum of the smaller over sum of the larger weights."""
        if not len(self.shingle) or not len(other.shingle):
            return 1.0 if len(self.shingle) == len(other.shingle) else 0.0
        at = np.minimum(np.searchsorted(other.shingle, self.shingle), len(other.shingle) - 1)
        same = other.shingle[at] == self.shingle
        shared = float(np.minimum(self.weight[same], other.weight[at[same]]).sum())
        return shared / (self.total + other.total - shared)


def likenesses(left: list[Weights], right: list[Weights]) -> np.ndarray:
    """The weighted Jaccard similarity of each text of ``left`` and each of ``right``; exact, by products of matrices.

    The smaller of two counts is the number of levels that both reach, so shared weight is a sum of
    products over levels; only shingles of both sides have columns, some at a time.
    """
    width = max(CELLS // max(len(left), len(right), 1), 1)
    some = [np.concatenate([w.shingle for w in side]) if side else np.zeros(0, U) for side in (left, right)]
    both = np.intersect1d(*some)
    shared = np.zeros((len(left), len(right)))
    for first in range(0, len(both), width):
        columns = both[first : first + width]
        sides, idf = [], np.zeros(len(columns))
        for side in (left, right):
            counts = np.zeros((len(side), len(columns)), np.float32)
            for k, w in enumerate(side):
                at = np.minimum(np.searchsorted(columns, w.shingle), len(columns) - 1)
                same = columns[at] == w.shingle
                counts[k, at[same]] = w.count[same]
                idf[at[same]] = w.weight[same] / w.count[same]
            sides.append(counts)
        level = 1
        while True:
            a, b = (sides[0] >= level), (sides[1] >= level)
            live = a.any(axis=0) & b.any(axis=0)
            if not live.any():
                break
            sides, idf = [side[:, live] for side in sides], idf[live]
            shared += (a[:, live] * idf) @ b[:, live].T.astype(np.float64)
            level += 1
    total = np.array([w.total for w in left])[:, None] + np.array([w.total for w in right])[None, :] - shared
    return shared / np.maximum(total, 1e-300)
