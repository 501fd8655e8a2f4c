"""Packing of token sequences: first-fit decreasing in randomised groups of documents.

A document's full windows are sequences by themselves. Its rest goes into the bins of its
group, largest rest first, each into the first bin with room, which a tournament tree of
the bins' free space finds in logarithmic time. The rests of the emptiest bins are then cut
to fill the gaps left in the others, and what remains at the end goes into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.chunks import Encoder, shared
from stewardry.llm.frames import apart, flat, slices

LENGTH = 1024
END_ID = 0
#: rests that are packed together
GROUP = 4096
#: gaps of fewer tokens stay padding
LEAST_CUT = 2

#: rows that are read and sent on at a time
ROWS = 2048

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
TOKENS = "doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long, deal long"


class Tournament:
    """Free space of bins in order; each inner node holds the most of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.width)

    def first_fit(self, size: int) -> int:
        """Takes ``size`` from the first bin that has it; there are bins enough."""
        tree, node = self.tree, 1
        while node < self.width:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        found = node - self.width
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return found


def pack(sizes: list[int], length: int = LENGTH, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, from, to), items at most ``length`` long, cut where it pays."""
    if not sizes:
        return []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree = Tournament(len(sizes), length)
    bins: list[list[tuple[int, int, int]]] = []
    for i in order:
        if sizes[i] == 0:
            continue
        b = tree.first_fit(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append((i, 0, sizes[i]))
    free = [length - sum(t - s for _, s, t in b) for b in bins]
    # fullest first; the emptiest give their pieces away
    gaps = sorted((b for b in range(len(bins)) if free[b] >= least_cut), key=lambda b: (free[b], b))
    low, high = 0, len(gaps) - 1
    while low < high:
        to, giver = gaps[low], gaps[high]
        if free[to] < least_cut:
            low += 1
            continue
        if not bins[giver]:
            high -= 1
            continue
        i, s, t = bins[giver].pop()
        take = min(t - s, free[to])
        bins[to].append((i, s, s + take))
        free[to] -= take
        if take < t - s:
            bins[giver].append((i, s + take, t))
        free[giver] += take
    out = []
    for b, pieces in enumerate(bins):
        total = length - free[b]
        if not pieces:
            continue
        if free[b] < least_cut:
            out.append(pieces)
            continue
        # the last one: parts whose lengths are powers of two
        pending = list(reversed(pieces))
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            row = []
            while room:
                i, s, t = pending.pop()
                take = min(t - s, room)
                row.append((i, s, s + take))
                room -= take
                if take < t - s:
                    pending.append((i, s + take, t))
            out.append(row)
    return out


def _tokenizer(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(pieces), 5000):  # the library's results are large
            texts = [p.decode() for p in pieces[at : at + 5000]]
            out += [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        return out

    return Encoder(encode)


def _tokenized(path: str, length: int):
    """A row with its ids for each full window, and one for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(("tokenizer", path), lambda: _tokenizer(path))
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds = encoder(*flat(batch.column("text")))
                rows: list[tuple] = []
                ids_of, deal = batch.column("doc_id").to_pylist(), apart(batch.column("deal").to_numpy()).tolist()
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], END_ID).astype("<u4")
                    n = len(own)
                    for s in range(0, n, length):
                        part = own[s : s + length].tobytes()
                        rows.append((ids_of[d], s, len(part) // 4, n, part, zlib.crc32(part), deal[d]))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.int64()),
                        pa.array(columns[6], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "deal"],
                )

    return run


def _packed(length: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        rests: list[tuple[int | None, int, int, bytes]] = []

        def flush() -> list[tuple]:
            nonlocal sequence
            rows = []
            for pieces in pack([len(r[3]) // 4 for r in rests], length):
                at = 0
                for i, s, t in pieces:
                    doc, start, n, ids = rests[i]
                    own = ids[4 * s : 4 * t]
                    rows.append((doc, start + s, t - s, zlib.crc32(own), n, sequence, at, own))
                    at += t - s
                sequence += 1
            rests.clear()
            return rows

        def record(rows: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in OUT.split(", ")]
            *columns, parts = zip(*rows, strict=True)
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), ids], names=names)

        names = ("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32")
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch, rows = whole.slice(first, ROWS), []
                for doc, start, n, total, ids, crc in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if n == length:
                        rows.append((doc, start, n, crc, total, sequence, 0, ids))
                        sequence += 1
                    else:
                        rests.append((doc, start, total, ids))
                        if len(rests) == group:
                            rows += flush()
                if rows:
                    yield record(rows)
        if rests:
            yield record(flush())

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, group: int = GROUP, seed: int = 7
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    A sequence is the ``ids`` of its pieces in the order of ``offset``.

    A document is its ids by the byte-level ``vocabulary`` (a tokenizers file), then id 0; a
    null or empty text is that id alone. Documents are dealt out by a hash of id, text
    and seed, equal rows of a batch to different tasks, so groups are random, of bounded size
    and the same on a repeated run. An empty table gives no
    rows; other columns are ignored.
    """
    dealt = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text",
        F.shiftright(F.xxhash64(F.lit(seed), "doc_id", "text"), 1).alias("deal"),
    )
    pieces = dealt.mapInArrow(_tokenized(vocabulary, length), TOKENS)
    order = ["deal", "doc_id", "start", "doc_tokens", "ids_crc32"]
    return pieces.repartition("deal").sortWithinPartitions(*order).mapInArrow(_packed(length, group), OUT)
