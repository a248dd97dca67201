"""Where byte strings of a given length repeat: sampled places and hashes of what surrounds them.

Every window of LENGTH bytes picks one of its GRAM-byte strings, the one with the least hash (the
leftmost of equals), so equal windows pick at the same place inside them. Such a place, an anchor,
stands for a run of neighbouring windows, all within its context (LEFT bytes before it, LENGTH after
it). Only windows whose anchors have equal grams can be equal.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .ragged import U, Buffer, mixed, prefix_of, window_hash

LENGTH, GRAM = 200, 64
CHOICES = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
#: A window of LENGTH bytes has so many bytes before or behind its gram.
HALF = LEFT // 2
GRAM_SEED, WINDOW_SEED = 0xA11CE, 0xB0B5
#: Places that are worked on at once, and the bits of a hash that give way to a place among them and CHOICES more.
CHUNK, PLACE_BITS = 1 << 20, 21
GROUP_BYTES = 2_000_000


class Anchors(NamedTuple):
    doc: np.ndarray
    place: np.ndarray  # in the buffer
    first: np.ndarray  # of the windows that picked it, in the buffer
    last: np.ndarray
    gram: np.ndarray  # hashes
    context: np.ndarray
    before: np.ndarray  # of the gram and HALF bytes before it
    behind: np.ndarray  # of the gram and HALF bytes behind it


def anchors(buffer: Buffer) -> Anchors:
    """All anchors of all texts of a buffer, in order; texts shorter than LENGTH have none. A text may have any length."""
    ends = buffer.starts + buffer.lengths
    runs = np.maximum(buffer.lengths - LENGTH + 1, 0)
    none = np.zeros(0, np.int64)
    parts = [Anchors(none, none, none, none, *[none.astype(U)] * 4)]
    for place in range(0, len(buffer.data), CHUNK):
        low = np.maximum(buffer.starts, place)
        many = np.maximum(np.minimum(buffer.starts + runs, place + CHUNK) - low, 0)
        doc = np.repeat(np.arange(len(runs)), many)
        if not len(doc):
            continue
        window = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + low[doc]
        part = _anchors_of(buffer, ends, doc, window)
        last = parts[-1]
        if len(last.doc) and last.place[-1] == part.place[0] and last.doc[-1] == part.doc[0]:  # one anchor, parted by the end of a chunk
            last.last[-1] = part.last[0]
            part = Anchors(*(x[1:] for x in part))
        parts.append(part)
    return Anchors(*(np.concatenate(x) for x in zip(*parts)))


def _anchors_of(buffer: Buffer, ends: np.ndarray, owner: np.ndarray, window: np.ndarray) -> Anchors:
    """The anchors of some windows (places in the buffer, in order) of texts ``owner``."""
    origin = max(0, int(window[0]) - LEFT)
    data = buffer.data[origin : int(window[-1]) + CHOICES + LENGTH]
    prefix = prefix_of(data, GRAM_SEED)
    here = window - origin
    at = np.arange(here[0], here[-1] + CHOICES)
    gram = window_hash(prefix, at, at + GRAM)
    low = U((1 << PLACE_BITS) - 1)
    least = (gram & ~low) | np.arange(len(at), dtype=U)
    reach = 1
    while reach * 2 <= CHOICES:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < CHOICES:
        least = np.minimum(least[: len(least) - (CHOICES - reach)], least[CHOICES - reach :])
    pick = (least[here - here[0]] & low).astype(np.int64) + window[0]
    change = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])])
    stop = np.r_[change[1:], len(pick)] - 1
    doc, place = owner[change], pick[change]
    left, right = np.minimum(place - buffer.starts[doc], LEFT), np.minimum(ends[doc] - place, LENGTH)
    spot = place - origin
    around = window_hash(prefix, spot - left, spot + right)
    before = window_hash(prefix, spot - np.minimum(left, HALF), spot + GRAM)
    behind = window_hash(prefix, spot, spot + np.minimum(right, GRAM + HALF))
    return Anchors(doc, place, window[change], window[stop], gram[place - window[0]], mixed(around ^ (left * 1024 + right).astype(U)), before, behind)


def expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(every number of the ranges first..last, the range that it is of)."""
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def repeated_here(values: np.ndarray, owners: np.ndarray):
    """(whether each value comes more than once, whether each is the first of its value); pairs of value and owner are told apart only by place."""
    order = np.lexsort((owners, values))
    v = values[order]
    new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(new), len(v)])
    many, first = np.zeros(len(v), bool), np.zeros(len(v), bool)
    many[order] = np.repeat(size > 1, size)
    first[order] = new
    return many, first


def removed(n: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes covered by windows at first..last of a text of ``n`` bytes."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(last + LENGTH, n), -1)
    edge = np.diff(np.r_[False, np.cumsum(step[:-1]) > 0, False].view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
