"""Best-fit packing of token sequences by exact complements.

Documents become token ids with an end id. Longer ones are cut into pieces of the sequence length.
The driver sees only how many pieces there are of each length, at most as many numbers as a
sequence has tokens. Sums of one, two and three lengths are indexed by their value. From the longest
piece down, the gap beside it is looked up there and filled exactly by one
length, else by a pair, else by three lengths, as often as all of them are available; what is left
over goes best fit. Pieces of one length are exchangeable, so the plan is a short list of runs of
piece numbers, and the pieces find their places by a join on length and number. Token ids that are
asked for stay out of that; they are joined to the places by the number of their row.

Defined results: a null text counts as empty and gives one piece with the end id alone; a null id
stays null; repeated rows are packed as often as they come; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary
from .balanced import BalancedTree
from .common import gapless, released, tokenizer_path, workers_can_import, written


class SumIndex:
    """Single, pair and triple sums of the lengths of which there are pieces, by their sum.

    Pairs (x, y) with x >= y lie in one array by sum, the longest x first; so do triples, as their
    longest length and the sum of the other two, if that is in the index of pairs. ``counts`` is shared
    with whoever takes pieces away: entries whose pieces are used up are passed over, and for good at
    the head of a sum, as pieces never come back.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        size = len(counts) - 1
        lengths = np.flatnonzero(counts[1:])[::-1] + 1  # the longest first
        pairs = [(x + (y := lengths[(lengths <= x) & (lengths <= size - x)]), np.full(len(y), x)) for x in lengths]
        self.pair_at, self.pair_x = self._by_sum(pairs, size)
        sums = np.flatnonzero(np.diff(self.pair_at))  # that some pair has
        triples = [(x + (y := sums[(sums <= 2 * x) & (sums <= size - x)]), np.full(len(y), x)) for x in lengths]
        self.triple_at, self.triple_x = self._by_sum(triples, size)
        self.pair_head, self.triple_head = self.pair_at[:-1].copy(), self.triple_at[:-1].copy()

    @staticmethod
    def _by_sum(found, size: int):
        total = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        x = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(total, kind="stable")  # x falls within a sum
        return np.r_[0, np.cumsum(np.bincount(total, minlength=size + 1))], x[order]

    def pair(self, total: int, top: int, taken: int = 0):
        """The pair with this sum and the longest first length up to ``top``; one piece of length ``taken`` is spoken for."""
        at, end, counts = self.pair_head[total], self.pair_at[total + 1], self.counts
        x = self.pair_x[at:end]
        y = total - x
        gone = (counts[x] == 0) | (counts[y] == 0)
        ok = ~gone & (x <= top) & (counts[x] - (x == taken) > (x == y)) & (counts[y] - (y == taken) > 0)
        self.pair_head[total] = at + (int(gone.argmin()) if not gone.all() else len(x))
        return [int(x[k := ok.argmax()]), int(y[k])] if ok.any() else None

    def fill(self, gap: int, top: int):
        """Lengths of at most ``top`` that sum to ``gap``: one, else a pair, else three of them, longest first; None if there are none."""
        if gap <= top and self.counts[gap]:
            return [gap]
        if found := self.pair(gap, top):
            return found
        at, end = self.triple_head[gap], self.triple_at[gap + 1]
        for k in range(at, end):
            x = int(self.triple_x[k])
            if not self.counts[x]:
                self.triple_head[gap] += k == self.triple_head[gap]
            elif x <= top and (found := self.pair(gap - x, x, x)):
                return [x, *found]
        return None


def plan_packs(counts, size: int):
    """(lengths of a pack, number of such packs) for all pieces; counts[n] pieces have length n, n up to ``size``."""
    counts = np.asarray(counts, np.int64).copy()
    packs = []
    if counts[size]:
        packs.append(([size], int(counts[size])))
        counts[size] = 0
    index = SumIndex(counts)
    for n in range(size - 1, 0, -1):
        while counts[n]:
            counts[n] -= 1  # the piece itself; if it was the last one, no combination of its length is found any more
            found = index.fill(size - n, min(n, size - n))
            counts[n] += 1
            if found is None:
                break
            pack = [n, *found]
            times = min(int(counts[x]) // pack.count(x) for x in set(pack))
            for x in pack:
                counts[x] -= times
            packs.append((pack, times))
    return packs + best_fit(counts, size)


def best_fit(counts, size: int):
    """Best-fit-decreasing over counts of lengths; packs of one content are one entry."""
    room, content, rest = BalancedTree(), {}, counts.copy()
    fresh = 0
    for n in range(size, 0, -1):
        while rest[n]:
            found = room.at_least((n, -1))
            if found is None:
                each = size // n
                packs, odd = divmod(int(rest[n]), each)
                for some, k in ((packs, each), (1, odd)):
                    if some and k:
                        content[fresh] = ([n] * k, some)
                        if size - n * k:
                            room.add((size - n * k, fresh))
                        fresh += 1
                rest[n] = 0
                continue
            left, key = found
            room.remove(found)
            lengths, some = content.pop(key)
            each = min(left // n, int(rest[n]))
            filled = min(some, int(rest[n]) // each)
            rest[n] -= filled * each
            content[fresh] = ([*lengths, *[n] * each], filled)
            if left - n * each:
                room.add((left - n * each, fresh))
            fresh += 1
            if some > filled:
                content[fresh] = (lengths, some - filled)
                room.add((left, fresh))
                fresh += 1
    return list(content.values())


#: Number of a row of the table of pieces.
ROW = "_tm_row"
RUNS = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "first", "last", "first_sequence", "offset")])


def runs_of(packs):
    """Rows of RUNS: piece k of a length, first <= k < last, goes to sequence first_sequence + k - first at the offset."""
    used, sequence, runs = {}, 0, []
    for lengths, times in packs:
        offset = 0
        for n in lengths:
            first = used.get(n, 0)
            runs.append((n, first, first + times, sequence, offset))
            used[n] = first + times
            offset += n
        sequence += times
    return runs


def token_pieces(docs: DataFrame, size: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    workers_can_import(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids = vocabulary.ids(tokenizer_path(tokenizer))
        for batch in released(batches, "vocabulary"):
            keys, rows = batch.column(0), ([], [], [], [], [], [])
            for k, x in enumerate(ids.encoded(t.as_py() or "" for t in batch.column(1))):
                x += end
                n = len(x) // 4
                for piece, start in enumerate(range(0, n, size)):
                    part = x[4 * start : 4 * (start + size)]
                    for column, value in zip(rows, (k, piece, start, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)):
                        column.append(value)
            columns = [keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(rows[5], pa.list_(pa.int32()))] if with_ids else []), names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with the sequence it is packed into and its offset there."""
    pieces = token_pieces(docs, size, tokenizer, end_id, id_col, text_col, with_ids)
    # rows are numbered as they are written, so a row keeps its number whoever reads it
    pieces = written(pieces.withColumn(ROW, F.monotonically_increasing_id()) if with_ids else pieces, "pieces")
    counts = np.zeros(size + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `size` rows
        counts[length] = n
    runs = docs.sparkSession.createDataFrame(runs_of(plan_packs(counts, size)), RUNS)
    numbered = gapless(pieces.drop("ids") if with_ids else pieces, ["length"], [id_col, "piece", "ids_crc32"], "k")
    placed = numbered.join(runs, "length").where((F.col("k") >= F.col("first")) & (F.col("k") < F.col("last")))
    places = [id_col, "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("k") - F.col("first")).alias("sequence_id"), "offset"]
    if not with_ids:
        return placed.select(*places)
    # token ids are sent once, when their place is known; the planning is by the rows without them
    return placed.select(*places, ROW).join(pieces.select(ROW, "ids"), ROW).drop(ROW)
