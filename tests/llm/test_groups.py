"""Sharding, near-duplicates and repeated passages against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import sharding, weighted_minhash as wm
from tidemark.llm.balanced import BalancedTree
from tidemark.llm.links import components
from tidemark.llm.near_dedup import drop_near_duplicates, near_duplicates
from tidemark.llm.ragged import Buffer, shingles
from tidemark.llm.suffix_dedup import count_repeats, remove_repeats

from .conftest import ODD

# sharding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.lists(st.integers(0, 30), max_size=30))
def test_tree(items, bounds):
    tree, held = BalancedTree(), set()
    for x in items:
        if x in held:
            tree.remove(x)
            held.remove(x)
        else:
            tree.add(x)
            held.add(x)
    for b in bounds:
        assert tree.at_least(b) == min((x for x in held if x >= b), default=None)
    with pytest.raises(KeyError):
        tree.remove(99)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=50))
def test_packing_by_size_is_best_fit_decreasing(sizes):
    counts = Counter(sizes)
    runs = sharding.pack_sizes(sorted(counts, reverse=True), [counts[s] for s in sorted(counts, reverse=True)], 40)
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(left) if room >= s]
        if fits:
            left[min(fits, key=lambda k: (left[k], k))] -= s
        else:
            left.append(40 - s)
    got = defaultdict(int)
    for s, a, b, k in runs:
        got[k] += s * (b - a)
    assert sorted(got.values()) == sorted(40 - r for r in left)


def test_near_equal_bins():
    r = random.Random(4)
    sizes = Counter(r.randint(16, 3000) for _ in range(5000))
    order = sorted(sizes, reverse=True)
    runs = sharding.pack_into(order, [sizes[s] for s in order], 40)
    load = defaultdict(int)
    for s, a, b, k in runs:
        load[k] += s * (b - a)
    assert len(load) == 40 and sharding.largest_excess(load.values()) < 0.001
    whole = sharding.pack_into([1000, 1], [1, 200], 3)  # one group above the mean has a bin of its own
    load = defaultdict(int)
    for s, a, b, k in whole:
        load[k] += s * (b - a)
    assert sorted(load.values()) == [100, 100, 1000]
    assert sharding.pack_into([], [], 40) == []


def test_shard_query(spark, odd, none):
    rows = sharding.shard_documents(odd, shards=3).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2}
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_documents(none).count() == 0
    few = sharding.shard_documents(odd, shards=None, capacity=200)
    assert sum(r.bytes for r in sharding.shard_balance(few).collect()) == sum(r["size"] for r in rows)


# links


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=14))
def test_components(spark, links):
    top = list(range(15))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in range(15))


# near-duplicates


def frequencies(texts):
    counters = np.zeros((wm.ROWS, wm.WIDTH))
    for t in texts:
        s, _, _ = wm.document_shingles([t])
        for r, slot in enumerate(wm.slots(s)):
            np.add.at(counters[r], slot, 1)
    return wm.Frequencies(counters, len(texts))


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def edited(r, text, n):
    out = text.split()
    for _ in range(n):
        out[r.randrange(len(out))] = words(r, 1)
    return " ".join(out)


def test_shingles_are_runs_of_words():
    hashes, doc = shingles(Buffer([b"a b c d e f", b"A, b! c d E", b"x y", b"", b"--"]), 5, 1)
    assert doc.tolist() == [0, 0, 1, 2] and hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3


def test_samples_meet_as_often_as_texts_are_alike():
    r = random.Random(8)
    base = words(r, 400)
    texts = [base.encode(), *(edited(r, base, n).encode() for n in (5, 20, 60))]
    f = frequencies(texts)
    shingle, count, doc = wm.document_shingles(texts)
    sample = wm.samples(shingle, count * f.of(shingle), doc, len(texts))
    weights = [wm.Weights(t, f) for t in texts]
    for k in (1, 2, 3):
        assert abs((sample[0] == sample[k]).mean() - weights[0].likeness(weights[k])) < 0.17
    assert weights[0].likeness(weights[0]) == 1
    like = wm.likenesses(weights, weights)
    assert all(np.isclose(like[i, j], weights[i].likeness(weights[j])) for i in range(4) for j in range(4))


def test_near_duplicates_against_brute_force(spark, docs, monkeypatch):
    from tidemark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "VERY_LARGE", 40)
    monkeypatch.setattr(near_dedup, "LARGE", 10)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(6)
    hot, passage = words(r, 120), words(r, 40)
    rows = [hot] * 5 + [edited(r, hot, r.randint(1, 6)) for _ in range(60)]
    rows += [words(r, 50) + " " + passage for _ in range(30)]
    for _ in range(15):
        base = words(r, r.randint(6, 90))
        rows += [base, edited(r, base, r.randint(0, 3))]
    rows += ["only four words here", "only four words here", "Only four, words HERE!", "", "", "..."]
    r.shuffle(rows)
    raw = [t.encode() for t in rows]
    f = frequencies(raw)
    weights = [wm.Weights(t, f) for t in raw]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i] == rows[j] or len(weights[i].shingle) and weights[i].likeness(weights[j]) >= 0.8:
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    got = {q.doc_id: q.class_id for q in near_duplicates(docs(enumerate(rows))).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def lines_repeated(r):
    """Two texts that share lines which come many times, and differ in all else."""
    lines = [words(r, 8) for _ in range(r.randint(1, 3))]
    times = r.randint(20, 60)
    own = len(lines) * times * 8 // r.randint(6, 18)
    return [" ".join([" ".join(lines * times), words(r, own)]) for _ in range(2)]


def test_samples_follow_weights_of_repeated_lines():
    r = random.Random(12)
    texts = [t.encode() for _ in range(40) for t in lines_repeated(r)]
    f = frequencies(texts)
    weights = [wm.Weights(t, f) for t in texts]
    like = np.array([a.likeness(b) for a, b in zip(weights[::2], weights[1::2])])
    keys, _, _ = (np.concatenate(x) for x in zip(*wm.signatures(texts, f)))
    met = (keys[::2] == keys[1::2]).any(axis=1)
    assert (like >= 0.8).sum() > 15 and met[like >= 0.8].all()
    shingle, count, doc = wm.document_shingles(texts)
    sample = wm.samples(shingle, count * f.of(shingle), doc, len(texts), count)
    agree = (sample[::2] == sample[1::2]).mean(axis=1)
    assert abs(agree - like).max() < 0.17 and abs((agree - like).mean()) < 0.02


def test_near_duplicates_of_repeated_lines_against_brute_force(spark, docs):
    r = random.Random(13)
    rows = [t for _ in range(30) for t in lines_repeated(r)]
    f = frequencies([t.encode() for t in rows])
    weights = [wm.Weights(t.encode(), f) for t in rows]
    like = [a.likeness(b) >= 0.8 for a, b in zip(weights[::2], weights[1::2])]
    assert 10 < sum(like) < 30
    got = {q.doc_id: q.class_id for q in near_duplicates(docs(enumerate(rows))).collect()}
    assert got == {i: i - 1 if i % 2 and like[i // 2] else i for i in range(len(rows))}


def test_near_duplicate_edges(spark, odd, none, docs):
    got = near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.class_id for r in got}
    assert by[0] == by[4] == 0 and by[1] == by[2] == 1 and by[None] is None and by[-7] == -7 and by[8] == 8
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 1, None, 5, 6, -7, 8, 9])
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0
    shared = drop_near_duplicates(docs([(3, "the same text twice in two rows"), (None, "the same text twice in two rows")]))
    assert [r.doc_id for r in shared.collect()] == [3]


# repeated passages


def brute(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + size] for b in raw for p in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_against_brute_force(spark, docs, seed):
    r = random.Random(seed)
    passages = [words(r, r.randint(30, 90)) for _ in range(6)] + ["é" * 150 + words(r, 20), "ab" * 150, words(r, 34)[:200], words(r, 34)[:199]]
    texts = []
    for _ in range(60):
        parts = [words(r, r.randint(0, 30)) for _ in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            parts.insert(r.randint(0, len(parts)), r.choice([p, p, p[a:b]]))
        texts.append(r.choice(["", " "]).join(parts))
    texts += [texts[0], texts[0], "a" * 700, "ba" * 400, passages[0] + passages[0], "z" * 200, "q" * 201, "", None]
    got = {q.doc_id: (q.n_bytes, q.n_removed, q.n_spans, q.kept_sha256) for q in count_repeats(docs(enumerate(texts)).repartition(5)).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    left = {q.doc_id: q.text for q in remove_repeats(docs(enumerate(texts)), ).collect()}
    for i, (n, gone, _, digest) in enumerate(want):
        if not gone:
            assert left[i] == texts[i]
        elif (texts[i] or "").isascii():
            assert hashlib.sha256(left[i].encode()).hexdigest() == digest


def test_texts_longer_than_a_chunk(spark, docs, monkeypatch):
    from tidemark.llm import repeats

    monkeypatch.setattr(repeats, "CHUNK", 300)  # a text of many chunks has the anchors that it has as a whole
    r = random.Random(5)
    texts = [words(r, 400).encode(), b"short", ("é" * 700).encode(), b"", words(r, 90).encode(), b"z" * 1500]
    buffer = Buffer(texts)
    got = repeats.anchors(buffer)
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    for x, y in zip(got, repeats.anchors(buffer)):
        assert (x == y).all()
    assert len(repeats.anchors(Buffer([b"", b"x"])).doc) == 0


def test_repeat_edges(spark, odd, none):
    got = count_repeats(odd)
    want = brute([t for _, t in ODD])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == Counter((i, *w) for (i, _), w in zip(ODD, want))
    assert count_repeats(none).count() == 0
    kept = remove_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and remove_repeats(none).count() == 0
