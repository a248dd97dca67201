"""Offset-preserving encoding and decoding with a SentencePiece BPE model.

Normalisation takes, from left to right, the longest entry of the model's compiled character map
that the text goes on with, else one character, and notes for every character it writes where it
came from. The normalised text is split where no piece can cross, merged by piece scores, and every
piece is projected through those notes to a span of bytes of the original text. Characters outside
the vocabulary become byte pieces. Decoding joins the pieces and takes back the leading mark.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np

MARK = "▁"
KEPT_UNITS = 250_000
KEPT_LENGTH = 48
SHORT = 40


class CharacterMap:
    """The compiled map of a model: a double-array trie over bytes, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units = None
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int):
        """(length, replacement) of the longest entry that ``data`` has at ``at``, or None."""
        if self.units is None:
            return None
        units, found = self.units, None
        u = units[0]
        node = (u >> 10) << ((u & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            u = units[node]
            if u & 0x800000FF != data[k]:
                break
            node ^= (u >> 10) << ((u & 512) >> 6)
            if u >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end].decode("utf-8")


class Unit(NamedTuple):
    """A stretch of normalised text that no piece crosses."""

    ids: bytes  # 32-bit numbers
    widths: bytes  # source bytes of each piece, 16-bit numbers, each mark counted as one byte
    text: str  # as decoded, with spaces
    decimal: str  # the ids in decimal, each after a space


class Encoded(NamedTuple):
    ids: np.ndarray
    starts: np.ndarray  # byte offsets in the source text
    ends: np.ndarray
    decoded: str
    decimal: str


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self._setup(proto)

    def _setup(self, proto) -> None:
        trainer, norm = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type != 2 or trainer.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("a BPE model that marks spaces in front of words is needed")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id_of = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == 1}
        self.byte_ids = [None] * 256
        for k, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:-1], 16)] = k
        self.byte_of = {k: b for b, k in enumerate(self.byte_ids) if k is not None}
        self.fallback = trainer.byte_fallback and None not in self.byte_ids
        self.unk_id, self.unk_text = trainer.unk_id, trainer.unk_surface
        self.end_id = next((k for k, p in enumerate(proto.pieces) if p.piece == trainer.eos_piece and p.type == 3), None)
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece has a space after a letter")
        breaks = "\n" if not any("\n" in p for p in self.scores) and self.fallback else ""
        self._units = re.compile(f"{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+" + (f"|{breaks}" if breaks else ""))
        self.plain = self.map.units is None and self.prefix and not self.squeeze and self.fallback
        self.kept: dict[str, Unit] = {}
        self._widths = [len(p.replace(MARK, " ").encode("utf-8")) for p in self.pieces]
        self._decimals = [f" {k}" for k in range(len(self.pieces))]

    def normalised(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and, for each of its characters and its end, the byte offset of the source it comes from."""
        data, out, at = text.encode("utf-8"), [], []
        k, n, space = 0, len(data), self.squeeze
        steps = []
        while k < n:
            found = self.map.longest(data, k)
            if found is None:
                lead = data[k]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = (size, data[k : k + size].decode("utf-8"))
            steps.append((k, *found))
            k += found[0]
        if self.squeeze:
            first = next((i for i, s in enumerate(steps) if s[2].strip(" ")), len(steps))
            steps = steps[first:]
        if self.prefix and steps:
            out.append(MARK)
            at.append(steps[0][0])
        for start, _, new in steps:
            if space:
                new = new.lstrip(" ")
            for c in new:
                out.append(MARK if c == " " else c)
                at.append(start)
            if new:
                space = self.squeeze and new[-1] == " "
        end = n
        if self.squeeze:
            while len(out) > 1 and out[-1] == MARK:
                out.pop()
                end = at.pop()
        at.append(end)
        return "".join(out), at

    def merged(self, unit: str) -> list[str]:
        """The pieces of a unit: again and again the neighbours whose union scores best are joined, the leftmost of equals first."""
        get, none = self.scores.get, float("-inf")
        parts = list(unit)
        if len(parts) <= SHORT:
            gains = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            while gains and (best := max(gains)) != none:
                at = gains.index(best)
                joined = parts[at] + parts.pop(at + 1)
                parts[at] = joined
                del gains[at]
                if at:
                    gains[at - 1] = get(parts[at - 1] + joined, none)
                if at < len(gains):
                    gains[at] = get(joined + parts[at + 1], none)
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-g, k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (g := get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, joined = heapq.heappop(heap)
            if parts[k] is None or (r := after[k]) >= n or parts[k] + parts[r] != joined:
                continue
            parts[k], parts[r], after[k] = joined, None, after[r]
            if after[k] < n:
                before[after[k]] = k
                if (g := get(joined + parts[after[k]])) is not None:
                    heapq.heappush(heap, (-g, k, joined + parts[after[k]]))
            if before[k] >= 0 and (g := get(parts[before[k]] + joined)) is not None:
                heapq.heappush(heap, (-g, before[k], parts[before[k]] + joined))
        return [p for p in parts if p is not None]

    def _ids_and_chars(self, unit: str) -> list[tuple[int, int, int]]:
        """(id, characters of the unit, -1 or the number of the byte that it stands for) of each piece."""
        out = []
        for p in self.merged(unit):
            if (k := self.id_of.get(p)) is not None:
                out.append((k, len(p), -1))
            elif self.fallback:
                out += [(self.byte_ids[b], int(j == 0), j) for j, b in enumerate(p.encode("utf-8"))]
            elif out and out[-1][0] == self.unk_id:
                out[-1] = (self.unk_id, out[-1][1] + len(p), -1)
            else:
                out.append((self.unk_id, len(p), -1))
        return out

    def _unit(self, unit: str) -> Unit:
        try:
            ids = [self.id_of[p] for p in self.merged(unit)]
            widths, decimal = self._widths, self._decimals
            return Unit(array("i", ids).tobytes(), array("H", [widths[k] for k in ids]).tobytes(), unit.replace(MARK, " "), "".join([decimal[k] for k in ids]))
        except KeyError:  # characters outside the vocabulary
            pass
        found = self._ids_and_chars(unit)
        ids = [k for k, _, _ in found]
        widths, at = [], 0
        for _, n, byte in found:
            widths.append(1 if byte >= 0 else len(unit[at : at + n].replace(MARK, " ").encode("utf-8")))
            at += n
        return Unit(array("i", ids).tobytes(), array("H", widths).tobytes(), self.joined(ids), "".join(f" {k}" for k in ids))

    def joined(self, ids) -> str:
        """The text of ids without taking back the leading mark."""
        out, raw = [], bytearray()
        for k in ids:
            if (b := self.byte_of.get(k)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if self.kinds[k] == 2:
                out.append(self.unk_text)
            elif self.kinds[k] != 3:
                out.append(self.pieces[k].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.joined(ids)
        real = next((k for k in ids if self.kinds[k] != 3), None)
        if real is not None and (self.prefix or self.squeeze) and self.pieces[real].startswith(MARK):
            text = text[1:]
        return text

    def encode(self, text: str) -> Encoded:
        if not text:
            return Encoded(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), "", "")
        if not self.plain or MARK in text:
            return self._encode_aligned(text)
        kept, units = self.kept, []
        for u in self._units.findall(MARK + text.replace(" ", MARK)):
            x = kept.get(u)
            if x is None:
                x = self._unit(u)
                if len(kept) < KEPT_UNITS and len(u) <= KEPT_LENGTH:
                    kept[u] = x
            units.append(x)
        ids, widths, texts, decimals = zip(*units)
        width = np.frombuffer(b"".join(widths), np.uint16).astype(np.int64)
        width[0] -= 1  # the leading mark isn't in the source
        ends = np.cumsum(width)
        return Encoded(np.frombuffer(b"".join(ids), np.int32), ends - width, ends, "".join(texts)[1:], "".join(decimals)[1:])

    def _encode_aligned(self, text: str) -> Encoded:
        norm, source = self.normalised(text)
        ids, starts, ends, at = [], [], [], 0
        for unit in self._units.findall(norm):
            for k, n, byte in self._ids_and_chars(unit):
                if byte <= 0:
                    at, first = at + n, at
                start, end = source[first], source[at]
                if byte >= 0:
                    own = len(norm[first].encode("utf-8"))
                    start, end = (start + byte, start + byte + 1) if end - start == own else (start if byte == 0 else end, end)
                ids.append(k)
                starts.append(start)
                ends.append(end)
        return Encoded(np.array(ids, np.int32), np.array(starts, np.int64), np.array(ends, np.int64), self.decode(ids), " ".join(map(str, ids)))


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)
