"""Token counts, packing and piece coding against the libraries."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, pieces, vocabulary
from tidemark.llm.common import released, tokenizer_path
from tidemark.llm.piece_coding import DIGESTS, encode_documents
from tidemark.llm.token_counts import count_tokens

from .conftest import ODD

WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
HARD = ["", " ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "x\x1cy\x85z", "ΣΑΣ İstanbul ſ K Å ẞ ͅ é", "'S'll can't I'D _a_1b²³", "a" * 3000, "ab" * 1500, "̈x ̈", "foo</w> <|endoftext", "漢字 한국어 𝔘𝔫𝔦 👩‍👩‍👧", "▁a▁ b", "</s><unk><0x0A>", "x" + " " * 90 + "y", "\x00\x01\n\n a  b\t"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def scrambled(seed, n=120):
    r = random.Random(seed)
    kinds = [(1, 0x7F), (0x80, 0x24F), (0x250, 0xD7FF), (0xE000, 0x1FFFF), (0x20, 0x20), (0x2581, 0x2581), (0x0A, 0x0A)]
    return ["".join(chr(r.randint(*r.choice(kinds))) for _ in range(40)) for _ in range(n)]


def test_counts_and_ids_as_the_library(library):
    texts = HARD + scrambled(1)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(vocabulary.TokenCounter(WORD).counts(texts)) == [len(w) for w in want]
    assert [np.frombuffer(b, "<u4").tolist() for b in vocabulary.TokenIds(WORD).encoded(texts)] == want


def test_tables_of_chunks_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(vocabulary, "KEPT_CHUNKS", 50)
    monkeypatch.setattr(vocabulary, "KEPT_WORDS", 20)
    monkeypatch.setattr(vocabulary, "GROUP_CHARS", 400)
    texts = scrambled(2, 60) + ["the same words again and again"] * 20
    counter = vocabulary.TokenCounter(WORD)
    assert list(counter.counts(texts)) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counter.kept) <= 50 and len(counter.words) <= 20


def test_workers_let_go_of_what_others_keep():
    from tidemark.llm.ragged import POWERS

    assert not hasattr(vocabulary.ids(WORD), "spec")  # 27 MB
    POWERS.of(1000)
    assert list(released(iter([1, 2]), "vocabulary")) == [1, 2] and vocabulary.ids.cache_info().currsize == 1 and len(POWERS.up) == 1
    up, down = POWERS.of(300_000)
    assert 300_000 <= len(up) <= 600_000 and (up * down == 1).all()
    assert list(released(iter([3]))) == [3] and vocabulary.ids.cache_info().currsize == 0 and len(POWERS.up) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=12), min_size=1, max_size=6))
def test_merging_against_one_pair_at_a_time(words):
    """A tiny vocabulary: a=0, b=1, ab=2, aa=3, abab=4, bb=5."""
    left, right, merged = [0, 0, 2, 1], [1, 0, 2, 1], [2, 3, 4, 5]
    table = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left, right, merged))}

    def plain(seq):
        seq = list(seq)
        while True:
            found = [(table[p][0], k) for k, p in enumerate(zip(seq, seq[1:])) if p in table]
            if not found:
                return seq
            _, k = min(found)
            seq[k : k + 2] = [table[seq[k], seq[k + 1]][1]]

    seqs = [[0 if c == "a" else 1 for c in w] for w in words]
    flat, lengths = vocabulary.RankMerger(left, right, merged, 6).merge(np.concatenate(seqs), [len(s) for s in seqs])
    want = [plain(s) for s in seqs]
    assert lengths.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        vocabulary.RankMerger([2, 0], [0, 1], [3, 2], 4)


def test_count_query(spark, odd, none, library):
    rows = count_tokens(odd, limit=100).collect()
    assert len(rows) == len(ODD)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert count_tokens(none).count() == 0


# packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plans_pack_everything(lengths):
    counts = np.bincount(lengths, minlength=33)
    packs = packing.plan_packs(counts, 32)
    used = Counter()
    for pack, times in packs:
        assert sum(pack) <= 32
        for n in pack:
            used[n] += times
    assert used == Counter(lengths)
    runs = packing.runs_of(packs)
    assert sum(r[2] - r[1] for r in runs) == len(lengths)
    fewest = -(-sum(lengths) // 32)
    assert sum(t for _, t in packs) <= max(fewest, int(1.5 * fewest) + 1)


def plain_fill(counts, gap, top):
    """One, two or three lengths of at most ``top``, tried one after the other, the longest first."""
    for n in (1, 2, 3):
        for pick in itertools.combinations_with_replacement(range(min(top, gap), 0, -1), n):
            if sum(pick) == gap and all(counts[x] >= pick.count(x) for x in pick):
                return list(pick)
    return None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=14), st.lists(st.tuples(st.integers(1, 24), st.integers(1, 24)), max_size=12))
def test_exact_fill(lengths, gaps):
    counts = np.bincount(lengths, minlength=25)
    index = packing.SumIndex(counts)
    for gap, top in gaps:
        found = index.fill(gap, top)
        assert found == plain_fill(counts, gap, top)
        for x in found or []:  # taken away, as a plan does
            counts[x] -= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=40))
def test_plans_against_a_plain_one(lengths):
    counts, want = np.bincount(lengths, minlength=25), []
    left = counts.copy()
    want += [[24]] * left[24]
    left[24] = 0
    for n in range(23, 0, -1):
        while left[n]:
            left[n] -= 1
            found = plain_fill(left, 24 - n, min(n, 24 - n))
            if found is None:
                left[n] += 1
                break
            for x in found:
                left[x] -= 1
            want.append([n, *found])
    packs = [p for pack, times in packing.plan_packs(counts, 24) for p in [pack] * times]
    assert Counter(map(tuple, want)) - Counter(map(tuple, packs)) == Counter()


def test_pack_query(spark, odd, none, library):
    size = 64
    rows = packing.pack_documents(odd, size=size, with_ids=True).collect()
    texts = {}
    for r in rows:
        assert r.length == len(r.ids) <= size and r.start == r.piece * size
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in texts.values():
        spots.sort()
        assert [o for o, _ in spots] == [0, *np.cumsum([n for _, n in spots]).tolist()[:-1]]
        assert sum(n for _, n in spots) <= size
    want = Counter()
    for i, t in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            want[i, k // size, tuple(ids[k : k + size])] += 1
    assert Counter((r.doc_id, r.piece, tuple(r.ids)) for r in rows) == want
    assert packing.pack_documents(none).count() == 0


def test_token_ids_are_sent_once(spark, odd):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packed = packing.pack_documents(odd, size=64, with_ids=True)
        text = packed._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        rows = Counter((r.doc_id, r.piece, tuple(r.ids), r.ids_crc32) for r in packed.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", text)
    assert dealt and sum(bool(re.search(r"\bids#", d)) for d in dealt) == 1
    assert all(c == zlib.crc32(np.array(x, "<u4").tobytes()) for _, _, x, c in rows)
    assert rows == Counter((r.doc_id, r.piece, tuple(r.ids), r.ids_crc32) for r in packing.token_pieces(odd, 64, with_ids=True).collect())


# piece coding


@pytest.fixture(scope="module")
def coder():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_pieces_as_the_library(coder):
    model = pieces.PieceModel(PIECE)
    for t in HARD + scrambled(3):
        e = model.encode(t)
        ids = coder.encode(t)
        assert e.ids.tolist() == ids and e.decoded == coder.decode(ids) == model.decode(ids)
        assert e.decimal == " ".join(map(str, ids))
        raw = t.encode()
        if raw:
            assert e.starts[0] == 0 and e.ends[-1] == len(raw) and (e.starts[1:] == e.ends[:-1]).all()
        for k, a, b in zip(ids, e.starts, e.ends):
            own = model.pieces[k].replace("▁", " ")
            if k not in model.byte_of and "▁" not in t and a:
                assert raw[a:b].decode() == own


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps(tmp_path, rule, squeeze):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, maps = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(open(PIECE, "rb").read())
    maps.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = maps.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "m.model"
    path.write_bytes(proto.SerializeToString())
    library, model = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceModel(str(path))
    for t in ["ﬁ①Ａ が ™  x　y ", "Ｔｅｓｔ ½", *(h for h in HARD if "▁" not in h)]:
        e = model.encode(t)
        assert e.ids.tolist() == library.encode(t) and model.decode(e.ids.tolist()) == library.decode(library.encode(t))
        assert (e.starts <= e.ends).all() and (len(e.ends) == 0 or e.ends[-1] <= len(t.encode()))


def test_long_units(coder):
    r = random.Random(5)
    t = "".join(r.choice("abcdefgh0123") for _ in range(5000))
    assert pieces.PieceModel(PIECE).encode(t).ids.tolist() == coder.encode(t)


def test_encode_query(spark, odd, none, coder):
    want = Counter()
    for i, t in ODD:
        ids = [*coder.encode(t or ""), coder.eos_id()]
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()] += 1
    got = encode_documents(odd, DIGESTS).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    full = {r.doc_id: r for r in encode_documents(odd).collect()}
    assert full[6].decoded == ODD[7][1] and len(full[6].starts) == len(full[6].ids) - 1
    assert encode_documents(none, DIGESTS).count() == 0
