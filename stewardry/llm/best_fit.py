"""Best-fit packing with swap-based local search.

A document's pieces of full length are sequences by themselves. Its rest goes into the bins of
its group, largest first, each into the fullest bin with room. Bins that are not full are then
searched: from the emptiest, one or two pieces go to a fuller bin in exchange for none, one or
two smaller ones, so that the sum of squared fills grows with every step, until that bin is
empty or no step is left. Bins that stay underfull are dealt out anew, together with those of
other groups, until they fit into one group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.chunks import shared
from stewardry.llm.frames import apart, flat, slices, written
from stewardry.llm.packing import _tokenizer

LENGTH = 4096
END_ID = 1
#: pieces that are packed together
GROUP = 8192
#: tokens that are read and sent on at a time
TOKENS = 1 << 20
#: steps to empty a bin, and bins in a row that may fail, before the local search ends
STEPS, TRIES = 120, 12
#: free tokens from which on a bin of one round is packed again in the next
UNDERFULL = 16

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, deal long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, deal long, sequence_id long, offset long, again boolean"
KEPT = [c.split()[0] for c in PIECE.split(", ")]


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins as lists of items: largest first, each into the bin that it leaves the least room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (free, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            free, b = length, len(bins)
            bins.append([])
        else:
            free, b = rooms.pop(at)
        bins[b].append(i)
        if free > sizes[i]:
            insort(rooms, (free - sizes[i], b))
    return bins


class LocalSearch:
    """Moves items between underfull bins so that the sum of squared fills grows.

    Taking ``d`` tokens more from a bin with ``a`` tokens into one with ``b`` than it gives
    back changes the sum by ``2 d (b - a + d)``. The emptiest bin is drained first. One that
    cannot be emptied within STEPS steps is left, and the search ends when no bin more can go
    (the rest would not fit into fewer) or TRIES bins in a row could not.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], length: int):
        self.size, self.length = np.array(sizes, np.int64), length
        self.home = np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins):
            self.home[items] = b
        self.free = length - np.bincount(self.home, self.size, len(bins)).astype(np.int64)

    def run(self) -> list[list[int]]:
        bins = len(self.free)
        spare = int((self.free < self.length).sum()) - -(-int(self.size.sum()) // self.length)
        failed, closed = 0, np.zeros(bins, bool)
        while spare > 0 and failed < TRIES:
            able = (self.free > 0) & (self.free < self.length) & ~closed
            if not able.any():
                break
            giver = int(np.argmax(np.where(able, self.free, -1)))
            if self._drain(giver):
                spare, failed = spare - 1, 0
            else:
                closed[giver], failed = True, failed + 1
        out: list[list[int]] = [[] for _ in range(bins)]
        for i, b in enumerate(self.home.tolist()):
            out[b].append(i)
        return [b for b in out if b]

    def _drain(self, giver: int) -> bool:
        """Whether ``giver`` could be emptied."""
        for _ in range(STEPS):
            own = np.flatnonzero(self.home == giver)
            if len(own) == 0:
                return True
            step = self._step(giver, own[np.argsort(-self.size[own], kind="stable")])
            if step is None:
                return False
            to, gives, takes = step
            moved = int(self.size[gives].sum() - self.size[takes].sum())
            self.home[gives], self.home[takes] = to, giver
            self.free[to] -= moved
            self.free[giver] += moved
        return not (self.home == giver).any()

    def _gain(self, d: np.ndarray, to: np.ndarray, giver: int) -> np.ndarray:
        """Growth of the sum where ``d`` tokens fit into bins ``to``, else 0."""
        grows = 2 * d * (self.free[giver] - self.free[to] + d)
        return np.where((d > 0) & (d <= self.free[to]) & (to != giver), grows, 0)

    def _step(self, giver: int, own: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
        """The first kind of step that helps, and of it the one that adds most: a move, one for
        one, two for one, one for two."""
        none = own[:0]
        target = np.flatnonzero((self.free > 0) & (self.free < self.length))
        for i in own:
            gain = self._gain(np.full(len(target), self.size[i]), target, giver)
            if len(gain) and gain.max() > 0:
                return int(target[np.argmax(gain)]), np.array([i]), none
        item = np.flatnonzero(self.free[self.home] > 0)
        size, home = self.size[item], self.home[item]
        one = [np.array([i]) for i in own]
        first, second = np.triu_indices(len(own), 1)
        two = [np.array([own[a], own[b]]) for a, b in zip(first.tolist(), second.tolist(), strict=True)]
        for gives in (*one, *two):
            gain = self._gain(self.size[gives].sum() - size, home, giver)
            if len(gain) and gain.max() > 0:
                at = int(np.argmax(gain))
                return int(home[at]), gives, item[at : at + 1]
        order = np.argsort(home, kind="stable")
        item, home = item[order], home[order]
        for apart in range(1, 9):  # two of one bin, up to eight places apart
            low, high = np.arange(len(item) - apart), np.arange(apart, len(item))
            same = home[low] == home[high] if len(low) else low.astype(bool)
            low, high = low[same], high[same]
            pair = self.size[item[low]] + self.size[item[high]]
            for i in own:
                gain = self._gain(self.size[i] - pair, home[low], giver)
                if len(gain) and gain.max() > 0:
                    at = int(np.argmax(gain))
                    return int(home[low[at]]), np.array([i]), np.array([item[low[at]], item[high[at]]])
        return None


def pack(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Bins of items, each item at most ``length`` long and never cut."""
    return LocalSearch(sizes, best_fit(sizes, length), length).run()


def _width(path: str) -> str:
    """Ids of a small vocabulary travel as two bytes."""
    return "<u2" if _tokenizer_size(path) <= 1 << 16 else "<u4"


def _tokenizer_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _pieces(path: str, length: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(("tokenizer", path), lambda: _tokenizer(path))
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds = encoder(*flat(batch.column("text")))
                rows: list[tuple] = []
                deals = apart(batch.column("deal").to_numpy()).tolist()
                for d, doc, deal in zip(range(batch.num_rows), batch.column("doc_id").to_pylist(), deals, strict=True):
                    own = np.append(ids[bounds[d] : bounds[d + 1]], END_ID)
                    for n, s in enumerate(range(0, len(own), length)):
                        part = own[s : s + length]
                        rows.append((doc, n, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), part.astype(width).tobytes(), deal + n))
                yield _batch(rows, PIECE)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def _packed(length: int, group: int, turn: int, last: bool):
    """Pieces with their places; the pieces of underfull bins are marked unless it is the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (turn << 54) | (TaskContext.get().partitionId() << 32)
        rests: list[tuple] = []
        rows: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal sequence
            for own in pack([r[3] for r in rests], length):
                again = not last and length - sum(rests[i][3] for i in own) >= UNDERFULL
                at = 0
                for i in own:
                    rows.append((*rests[i], sequence, at, again))
                    at += rests[i][3]
                sequence += 1
            rests.clear()

        for whole in batches:
            step = max(1, TOKENS // length)
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                for row in zip(*(batch.column(c).to_pylist() for c in KEPT), strict=True):
                    if row[3] == length:
                        rows.append((*row, sequence, 0, False))
                        sequence += 1
                    else:
                        rests.append(row)
                        held += row[3]
                        if len(rests) == group:
                            flush()
                while rows:
                    yield _batch(rows[:step], PLACED)
                    del rows[:step]
        flush()
        for first in range(0, len(rows), 1024):
            yield _batch(rows[first : first + 1024], PLACED)

    return run


def pack_whole(docs: DataFrame, vocabulary: str, length: int = LENGTH, group: int = GROUP, seed: int = 11) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids``.

    A document is its ids by ``vocabulary`` (a tokenizers file), then id 1; a null or empty
    text is that id alone. One of more than ``length`` ids is cut into pieces of that length,
    the last may be shorter; no other is cut. A sequence is the ``ids`` of its pieces in the
    order of ``offset``, ``length`` at most in all.

    Rows are dealt out by a hash of id, text and piece, equal rows of a batch to different
    tasks, so groups are random and of bounded size. Each round leaves underfull a few bins a
    group, and the next packs what is in them; rounds end when one group is left or bins do
    not get fewer. Repeated rows are documents of their own. An empty table gives no rows;
    other columns are ignored.
    """
    spark, width = docs.sparkSession, _width(vocabulary)
    dealt = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text",
        F.shiftright(F.xxhash64(F.lit(seed), "doc_id", "text"), 1).alias("deal"),
    )
    pieces = dealt.mapInArrow(_pieces(vocabulary, length, width), PIECE)
    order = ["deal", "doc_id", "piece", "length", "ids_crc32"]
    done, turn, parts, before, stuck = [], 0, 0, None, False
    while True:
        if turn == 0:
            spread = pieces.repartition("deal")
        else:
            spread = pieces.repartition(parts, "deal") if parts > 1 else pieces.repartition(1)
        # the last round is that of a single group, or of bins that no other group can fill
        last = turn > 0 and (parts == 1 or stuck)
        placed = spread.sortWithinPartitions(*order).mapInArrow(_packed(length, group, turn, last), PLACED)
        if last:
            done.append(placed)
            break
        placed = written(placed, "placed")
        done.append(placed.filter(~F.col("again")))
        pieces = placed.filter("again").select(*KEPT)
        left = pieces.count()
        if left == 0:
            break
        stuck = before is not None and left > before // 2
        parts, turn, before = -(-left // group), turn + 1, left
        pieces = pieces.withColumn("deal", F.shiftright(F.xxhash64(F.lit(seed + turn), "deal"), 1))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("again", "deal").mapInArrow(_as_arrays(width), OUT)


OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"


def _as_arrays(width: str):
    """Ids as arrays, a bounded number of tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                sizes = batch.column("length").to_numpy()
                ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), width).astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                names = [c.split()[0] for c in OUT.split(", ")][:-1]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))], names=[*names, "ids"]
                )

    return run
