"""Token counts and ids by a public byte-level BPE vocabulary with word ends.

``RankMerger`` holds many pre-tokens as one ragged numpy array and, step by step, applies the
lowest-rank pair of every pre-token at once. ``TokenCounter`` counts tokens with it;
``TokenIds`` takes ids from the tokenizers library. Both split a text at white space first: no
pre-token of such a vocabulary crosses it, so a chunk between white space always gives the same
tokens and is worked out once. Chunks are kept in a table of bounded size.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

from .common import keeps

NONE = np.iinfo(np.int64).max
#: Chunks and pre-tokens kept per worker; when that many are kept, others are worked out anew each time.
KEPT_CHUNKS, KEPT_WORDS = 250_000, 200_000
#: Longer ones are never kept.
KEPT_LENGTH = 64
#: Characters worked on together.
GROUP_CHARS = 1_000_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Merges of a BPE vocabulary on ragged arrays of symbols."""

    def __init__(self, left, right, merged, size: int):
        """Rank r merges left[r] and right[r] into merged[r]; symbols are below ``size``."""
        keys = np.asarray(left, np.int64) * size + np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.ranks = size, keys[order], order.astype(np.int64)
        self.merged = np.asarray(merged, np.int64)
        self.check_order(left, right)

    def check_order(self, left, right) -> None:
        """All pairs of the lowest rank may merge at once only if no merge that uses a symbol ranks below one that makes it."""
        made = {}
        for r, m in enumerate(self.merged.tolist()):
            made[m] = r
        for r, (a, b) in enumerate(zip(left, right)):
            if made.get(int(a), -1) >= r or made.get(int(b), -1) >= r:
                raise ValueError("a merge of this vocabulary uses a symbol that is made later")

    def rank(self, a, b):
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, symbols, lengths):
        """The surviving symbols and the lengths of all sequences, none of them empty."""
        lengths = np.asarray(lengths, np.int64)
        out_lengths = lengths.copy()
        out = [None] * len(lengths)
        which = np.arange(len(lengths))
        flat, lens = np.asarray(symbols, np.int64), lengths.copy()
        last = np.zeros(len(flat), bool)
        last[np.cumsum(lens) - 1] = True
        ranks = np.full(len(flat), NONE)
        pairs = np.flatnonzero(~last)
        ranks[pairs] = self.rank(flat[pairs], flat[pairs + 1])
        while len(which):
            starts = np.cumsum(lens) - lens
            best = np.minimum.reduceat(ranks, starts)
            going = best != NONE
            if not going.all():
                for k in np.flatnonzero(~going):
                    out[which[k]] = flat[starts[k] : starts[k] + lens[k]]
                    out_lengths[which[k]] = lens[k]
                stay = np.repeat(going, lens)
                flat, ranks, last = flat[stay], ranks[stay], last[stay]
                which, lens, best = which[going], lens[going], best[going]
                if not len(which):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, lens))
            if len(hits) > 1 and (np.diff(hits) == 1).any():
                run = np.r_[True, np.diff(hits) != 1]
                place = np.arange(len(hits))
                hits = hits[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            flat[hits] = self.merged[ranks[hits]]
            last[hits] = last[hits + 1]
            stay = np.ones(len(flat), bool)
            stay[hits + 1] = False
            owner = np.searchsorted(np.cumsum(lens), hits, side="right")
            lens = lens - np.bincount(owner, minlength=len(lens))
            at = hits - np.arange(len(hits))
            flat, ranks, last = flat[stay], ranks[stay], last[stay]
            ranks[at] = NONE
            anew = np.r_[at, at[at > 0] - 1]
            anew = anew[~last[anew]]
            ranks[anew] = self.rank(flat[anew], flat[anew + 1])
        return (np.concatenate(out) if out else flat), out_lengths


class _Chunks:
    """What both token classes share: splitting at white space, pre-tokens, and tables of both."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model, steps = self.spec["model"], self.spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [p["type"] for p in steps] != ["Split", "ByteLevel"] or model["ignore_merges"] or model["byte_fallback"]:
            raise ValueError("a byte-level BPE vocabulary with one split pattern is needed")
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        for t in self.spec["added_tokens"]:
            if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]):
                raise ValueError("added tokens that depend on their surroundings aren't supported")
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        spaces = [c for c in map(chr, range(0x3100)) if c.isspace() or c in "\u200b\u180e\ufeff"]
        gaps = [c for c in spaces if self.library.normalizer.normalize_str(f"a{c}a") == "a a"]
        if any(not c.isspace() for c in gaps):
            raise ValueError("white space of this vocabulary is wider than Python's")
        odd = [c for c in spaces if c.isspace() and c not in gaps]
        self._odd = re.compile("[" + "".join(map(re.escape, odd)) + "]") if odd else None
        self._gap = re.compile("[^" + "".join(map(re.escape, gaps)) + "]+")
        self._pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self._lines = regex.compile(steps[0]["pattern"]["Regex"] + "|\\n")
        # up to here no letter combines with its neighbours, and lower case needs no table of a version
        self._far = re.compile("[^\\x00-\\u024f]")
        self.letters = byte_letters()
        self._byte_of = {c: b for b, c in enumerate(self.letters)}
        self.kept: dict = {}
        self.words: dict = {}

    def chunks(self, text: str) -> list[str]:
        return self._gap.findall(text) if self._odd and self._odd.search(text) else text.split()

    def pre_tokens(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk without special strings, normalised."""
        if not self._far.search(chunk):
            return self._pattern.findall(chunk.lower())
        plain = self.library.normalizer.normalize_str(chunk)
        if not self._far.search(plain):
            return self._pattern.findall(plain)
        return [bytes(map(self._byte_of.__getitem__, x)).decode("utf-8") for x, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def parts(self, chunk: str) -> list:
        """Pre-tokens, and special strings as one-element tuples, in order."""
        if self._split is None:
            return self.pre_tokens(chunk)
        out = []
        for k, piece in enumerate(self._split.split(chunk)):
            out += [(piece,)] if k % 2 else self.pre_tokens(piece)
        return out

    def of_words(self, words: list[str]) -> list:
        """The value of each pre-token."""
        raise NotImplementedError

    def of_special(self, name: str):
        raise NotImplementedError

    def of_new(self, chunks: list[str]) -> list:
        """The value of each chunk; all are split at once, a line feed between them."""
        joined = "\n".join(chunks)
        if self._far.search(joined) or self._split and self._split.search(joined):
            flat = []
            for chunk in chunks:
                flat += self.parts(chunk)
                flat.append("\n")
        else:
            flat = self._lines.findall(joined.lower())
            flat.append("\n")
        words = self.words
        new = set(flat).difference(words)
        new.discard("\n")
        plain = [x for x in new if type(x) is str]
        fresh = dict(zip(plain, self.of_words(plain)))
        fresh |= {x: self.of_special(x[0]) for x in new if type(x) is tuple}
        words.update(fresh)
        values, value = [], self.nothing
        for x in flat:
            if x == "\n":
                values.append(value)
                value = self.nothing
            else:
                value += words[x]
        for x in self._too_many(fresh, len(words) - KEPT_WORDS):
            del words[x]
        return values

    @staticmethod
    def _too_many(fresh, excess: int) -> list:
        """Those of ``fresh`` that aren't kept: long ones and, if there are more than fit, the last."""
        names = list(fresh)
        out = [x for x in names if len(x) > KEPT_LENGTH]
        if excess > len(out):
            out += [x for x in names if len(x) <= KEPT_LENGTH][-(excess - len(out)) :]
        return out

    def groups(self, texts):
        """Chunk lists of groups of texts, in order; until the next group is asked for, ``kept`` has all their chunks."""
        group, size, kept = [], 0, self.kept
        for last, text in _marked(texts):
            if text is not None:
                group.append(self.chunks(text))
                size += len(text)
            if group and (last or size >= GROUP_CHARS):
                new = list(set().union(*group).difference(kept))
                if new:
                    kept.update(zip(new, self.of_new(new)))
                yield group
                for x in self._too_many(new, len(kept) - KEPT_CHUNKS):
                    del kept[x]
                group, size = [], 0


def _marked(texts):
    for text in texts:
        yield False, text
    yield True, None


class TokenCounter(_Chunks):
    """Counts of tokens by rank-synchronous merging, as the tokenizers library would count them."""

    nothing = 0

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merger = RankMerger([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], [vocab[a + b] for a, b in merges], max(vocab.values()) + 1)
        end = model["end_of_word_suffix"] or ""
        self._inner = np.array([vocab[c] for c in self.letters], np.int64)
        self._end = np.array([vocab[c + end] for c in self.letters], np.int64)

    def of_words(self, words):
        if not words:
            return []
        raw = [x.encode("utf-8") for x in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        ids = self._inner[symbols]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self._end[symbols[ends]]
        return self.merger.merge(ids, lengths)[1].tolist()

    def of_special(self, name):
        return 1

    def counts(self, texts):
        """The number of tokens of each text."""
        value = self.kept.__getitem__
        for group in self.groups(texts):
            for chunks in group:
                yield sum(map(value, chunks))


class TokenIds(_Chunks):
    """Ids as the tokenizers library gives them without begin and end, as bytes of little-endian 32-bit numbers."""

    nothing = b""

    def __init__(self, path: str):
        super().__init__(path)
        del self.spec  # its merges are in the library

    def of_words(self, words):
        tokenize, letters = self.library.model.tokenize, self.letters
        names = (x if x.isascii() and x.isprintable() else "".join(map(letters.__getitem__, x.encode("utf-8"))) for x in words)
        return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in names]

    def of_special(self, name):
        return array("I", [self.special[name]]).tobytes()

    def encoded(self, texts):
        value = self.kept.__getitem__
        for group in self.groups(texts):
            for chunks in group:
                yield b"".join(map(value, chunks))


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


@lru_cache(maxsize=4)
def ids(path: str) -> TokenIds:
    return TokenIds(path)


def _let_go():
    counter.cache_clear()
    ids.cache_clear()


keeps("vocabulary", _let_go)
