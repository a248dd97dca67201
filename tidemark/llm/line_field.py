"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are measured shares of its bytes and words and those of the
lines before and after it; a chain couples neighbours. The field is fitted by gradient ascent on
one weighted likelihood of labelled documents, each line bearing its document's label. A document's score
is the mean of its lines' marginals (forward-backward), weighted by line length, brought to a
probability by a logistic curve fitted on the same documents.

Fitting takes at most ``max_documents`` labelled documents of at most ``max_chars`` characters,
chosen by a hash of the id; scoring covers all documents and whole texts.

Defined results: a null or empty text is one empty line and gets that line's score; a null id isn't
held out; of contradicting labels of an id the smallest counts; without labels of both kinds every
score is the share of good ones, or 0.5 without any; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, workers_can_import
from .ragged import Buffer, byte_numbers, groups_of

#: Kinds of bytes; a continuation byte is none of them.
LETTER, UPPER, DIGIT, SPACE, STOP, SHOUT, BAR, SYMBOL = range(1, 9)
KIND = np.zeros(256, np.uint8)
KIND[33:127] = SYMBOL
for _a, _b, _k in (("a", "z", LETTER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
    KIND[ord(_a) : ord(_b) + 1] = _k
KIND[192:] = LETTER
for _c, _k in ((" \t", SPACE), (".,;:'?-\"()", STOP), ("!", SHOUT), ("|", BAR)):
    KIND[[ord(c) for c in _c]] = _k
FEATURES = 14
GROUP_BYTES = 1_000_000


def measured(texts: list[str]):
    """(features of each line, bytes of each line with one for its end, lines of each text)."""
    buffer = Buffer([t.encode("utf-8") for t in texts])
    data = buffer.data
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = (ends - starts + 1).astype(np.float64)
    kinds = KIND[data]
    count = {k: np.add.reduceat(kinds == k, starts, dtype=np.int64).astype(np.float64) for k in range(1, 9)}
    space = (kinds == SPACE) | (data == 10)
    edge = np.diff(np.r_[True, space].view(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line_of = np.searchsorted(ends, first)
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float64)
    same = np.zeros(len(ends))
    if len(first) > 1:
        sums = np.r_[np.uint64(0), np.cumsum(byte_numbers(7)[data])]
        word = sums[last] - sums[first]
        again = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
        same = np.bincount(line_of[1:][again], minlength=len(ends)).astype(np.float64)
    chars = np.maximum(sum(count.values()), 1.0)
    letters = np.maximum(count[LETTER] + count[UPPER], 1.0)
    sums = np.r_[np.uint64(0), np.cumsum(byte_numbers(11)[data] * np.uint64(31))]
    lines = np.bincount(np.searchsorted(buffer.starts, starts, side="right") - 1, minlength=len(texts))
    owner = np.repeat(np.arange(len(texts)), lines)
    key = (sums[ends] - sums[starts]) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    filled = np.maximum(words, 1.0)
    x = np.stack(
        [
            np.log1p(size), count[UPPER] / letters, count[DIGIT] / chars, count[SPACE] / chars, count[STOP] / chars, count[SHOUT] / chars, count[BAR] / chars, count[SYMBOL] / chars,
            letters / chars, np.minimum(chars / filled, 40.0) / 10, same / filled, (times[where] > 1) & (size > 1), words == 0, np.sqrt(count[SYMBOL] + count[SHOUT] + count[BAR]) / np.sqrt(filled),
        ],
        axis=1,
    )
    return x.astype(np.float64), size, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's own features, the line's before and the line's after; at the ends of a text zeros, and marks that there is none."""
    n = len(x)
    ends = np.cumsum(lines) - 1
    starts = ends - lines + 1
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts], after[ends] = 0, 0
    edges = np.zeros((n, 2))
    edges[starts, 0] = 1
    edges[ends, 1] = 1
    return np.concatenate([x, before, after, edges, np.ones((n, 1))], axis=1)


def marginals(emission: np.ndarray, transition: np.ndarray, lines: np.ndarray, share: np.ndarray | None = None):
    """(probability that each line is good, probabilities of neighbours' label pairs summed, log of the sum over all labellings).

    ``share`` weighs the texts in the sum over pairs.

    ``emission`` is the score of label good, that of bad is 0. Texts are worked on side by side, the longest first.
    """
    ends = np.cumsum(lines)
    starts = ends - lines
    order = np.argsort(-lines, kind="stable")
    lengths, first = lines[order], starts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # how many texts have a line t
    forward, backward = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    for t in range(steps):
        at = first[: alive[t]] + t
        e = np.stack([np.zeros(len(at)), emission[at]], axis=1)
        if t:
            p = forward[at - 1][:, :, None] + transition[None]
            e = e + np.logaddexp(p[:, 0], p[:, 1])
        forward[at] = e
    for t in range(steps - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        p = transition[None] + np.stack([np.zeros(len(at)), emission[at + 1]], axis=1)[:, None, :] + backward[at + 1][:, None, :]
        backward[at] = np.logaddexp(p[:, :, 0], p[:, :, 1])
    total = np.logaddexp(*forward[ends - 1].T) if len(lines) else np.zeros(0)
    line_total = np.repeat(total, lines)
    good = np.exp(np.minimum(0, forward[:, 1] + backward[:, 1] - line_total))
    inner = np.ones(len(emission), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + transition[None] + np.stack([np.zeros(len(at)), emission[at]], axis=1)[:, None, :] + backward[at][:, None, :] - line_total[at][:, None, None]
    pair = np.exp(np.minimum(0, pair))
    return good, (pair if share is None else pair * np.repeat(share, lines)[at][:, None, None]).sum(axis=0), total


def likelihood(x: np.ndarray, weights: np.ndarray, transition: np.ndarray, lines: np.ndarray, labels: np.ndarray, share: np.ndarray, decay: float):
    """(weighted log-likelihood of texts whose lines all bear their text's label, less a penalty; its slopes by weights and by transitions)."""
    target = np.repeat(labels, lines)
    emission = x @ weights
    good, pairs, total = marginals(emission, transition, lines, share)
    each = np.repeat(share, lines)
    alike = np.array([(share * (lines - 1))[labels == label].sum() for label in (0, 1)])  # neighbours of a text have its label
    value = (each * target * emission).sum() + alike @ np.diag(transition) - share @ total - decay / 2 * ((weights**2).sum() + (transition**2).sum())
    return value, x.T @ (each * (target - good)) - decay * weights, np.diag(alike) - pairs - decay * transition


def weighted_means(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lines) - lines
    return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts) if len(lines) else np.zeros(0)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class LineField:
    """A fitted field."""

    def __init__(self, mean, scale, weights, transition, curve, constant=None):
        self.mean, self.scale, self.weights, self.transition, self.curve, self.constant = mean, scale, weights, transition, curve, constant

    @classmethod
    def fitted(cls, texts: list[str], labels, rounds: int = 200, rate: float = 0.08, decay: float = 1e-3) -> LineField:
        y = np.asarray(labels, np.float64)
        if not len(y) or y.min() == y.max():
            return cls(None, None, None, None, None, float(y.mean()) if len(y) else 0.5)
        raw, size, lines = measured(texts)
        mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
        x = with_neighbours(np.clip((raw - mean) / scale, -4, 4), lines)
        # documents count alike, whatever their number of lines, and both labels count alike
        share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / lines / len(y)
        w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
        moments = [np.zeros_like(p) for p in (w, trans)], [np.zeros_like(p) for p in (w, trans)]
        for step in range(1, rounds + 1):
            _, slope, pairs = likelihood(x, w, trans, lines, y, share, decay)
            for p, g, m, v in ((w, slope, moments[0][0], moments[1][0]), (trans, pairs, moments[0][1], moments[1][1])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        out = cls(mean, scale, w, trans, (1.0, 0.0))
        z = _logit(out.means(raw, size, lines))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of the logistic curve, held back a little
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((y - p) * z).sum() - 0.01 * (a - 1), (y - p).sum()])
            h = np.array([[(s * z * z).sum() + 0.01, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
            da, db = np.linalg.solve(h, g)
            a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        out.curve = (float(a), float(b))
        return out

    def means(self, raw, size, lines):
        x = with_neighbours(np.clip((raw - self.mean) / self.scale, -4, 4), lines)
        good, _, _ = marginals(x @ self.weights, self.transition, lines)
        return weighted_means(good, size, lines)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = []
        for part in groups_of(texts, map(len, texts), GROUP_BYTES):
            z = _logit(self.means(*measured(texts[part])))
            out.append(1 / (1 + np.exp(-np.clip(self.curve[0] * z + self.curve[1], -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_documents: int = 2000, max_chars: int = 50_000) -> LineField:
    """A field fitted on labelled rows that aren't held out."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1) & ~held_out(id_col))
    chosen = known.groupBy(id_col).agg(F.min("label").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(max_documents)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen), id_col).select("text", "label").orderBy(F.xxhash64("text"), "label").limit(max_documents).toArrow()
    return LineField.fitted(rows.column("text").to_pylist(), rows.column("label").to_numpy())


def score_quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the quality score of each row's whole text."""
    workers_can_import(docs.sparkSession)

    def run(batches):
        for batch in released(batches):
            scores = field.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double")


def quality_score(field: LineField, text: Column) -> Column:
    """The score of a column of texts; only the texts go to the Python workers, and only the scores come back."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(parts):
            yield pa.array(field.scores([t or "" for t in texts.to_pylist()]), pa.float64())

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text.cast("string"))


def keep_good(docs: DataFrame, field: LineField, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    workers_can_import(docs.sparkSession)
    return docs.where(quality_score(field, F.col(text_col)) >= threshold)
