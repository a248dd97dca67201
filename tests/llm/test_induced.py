"""External induced sorting against plain sorting."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.induced_sorting import DiskQueue, InducedSorter, repeated_windows


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(0, 5)), max_size=60), st.integers(1, 7))
def test_queue_on_disk(items, held):
    queue = DiskQueue(2, None, held)
    for x in items:
        queue.push(x)
    assert [queue.pop() for _ in items] == sorted(items) and queue.head() is None


def plain(text, limit):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared, before = [], None
    for i in order:
        n = 0
        while before is not None and n < limit and i + n < len(text) and before + n < len(text) and text[i + n] == text[before + n]:
            n += 1
        shared.append((i, n))
        before = i
    return shared


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 4 + 97 for x in b)), st.integers(1, 9), st.sampled_from([2, 5, 200]))
def test_order_and_prefixes(text, held, limit):
    assert list(InducedSorter(held=held, limit=limit).suffixes(text)) == plain(text, limit)


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"abababab", b"mississippi", b"zyx" * 5, bytes(range(256)) * 2])
def test_known_texts(text):
    assert list(InducedSorter(held=3).suffixes(text)) == plain(text, 200)


def test_windows_against_brute_force():
    r = random.Random(2)
    passages = ["".join(r.choice("abc ") for _ in range(60)).encode() for _ in range(3)]
    texts = [b"".join(r.choice([*passages, bytes(r.choices(b"xyz", k=20))]) for _ in range(4)) for _ in range(8)] + [b"", b"a" * 50]
    got = repeated_windows(texts, 20, InducedSorter(held=100, limit=20))
    where = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - 19):
            where.setdefault(t[p : p + 20], []).append((k, p))
    for k, t in enumerate(texts):
        want = np.array([p <= len(t) - 20 and len(where[t[p : p + 20]]) > 1 for p in range(len(t))], bool)
        assert (got[k] == want).all()
