"""I-Match fingerprints: hashes of a document's informative terms.

A lexicon keeps the terms whose document frequency lies in a band. A document's distinct
lexicon terms are sorted and hashed once for each of several randomised subsets of the
lexicon, so a changed term spoils only the subsets that hold it. Subsets thin out step by
step: long documents are told by the thin ones, short ones by the dense ones.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm import words
from stewardry.llm.frames import flat, slices, written

#: Band of the share of documents that hold a term. A share of at least LOW bounds the
#: lexicon: terms a document / LOW entries, however many documents there are.
LOW, HIGH = 0.0005, 0.05
#: shares of the lexicon that subsets keep, and subsets of each share
SHARES = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
EACH = 10
#: A text with fewer lexicon terms is told by all its terms.
LEAST = 8
NONE = np.uint32(0)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of this task's documents hold each term; how many there are at the null term."""
    counts, n = Counts(), 0
    for whole in batches:
        for batch in slices(whole, "text"):
            counts.add(distinct_terms(*flat(batch.column("text")))[1])
            n += batch.num_rows
    terms, times = counts.total()
    for at in range(0, len(terms), 100_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms[at : at + 100_000].view(np.int64)), pa.array(times[at : at + 100_000])], names=["term", "n"]
        )
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["term", "n"])


class Counts:
    """Numbers of equal 64-bit values seen, merged now and then."""

    def __init__(self) -> None:
        self.values, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.held = 0

    def add(self, values: np.ndarray) -> None:
        self.new.append(values)
        self.held += len(values)
        if self.held > max(2_000_000, len(self.values)):
            self.merge()

    def merge(self) -> None:
        if self.new:
            values, times = np.unique(np.concatenate(self.new), return_counts=True)
            both = np.concatenate([self.values, values])
            self.values, at = np.unique(both, return_inverse=True)
            self.times = np.bincount(at, np.concatenate([self.times, times]), len(self.values)).astype(np.int64)
            self.new, self.held = [], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        return self.values, self.times


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct word of each text, sorted within the text."""
    text, h = words.hashed(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    of, found = [], []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            own = np.unique(h[a:b])
            found.append(own)
            of.append(np.full(len(own), i))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(of), np.concatenate(found)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms that a share from ``low`` to ``high`` of all documents hold.

    Every document is counted; a term is one row a task in the shuffle. At least two
    documents must hold a term. As frequencies add up to the documents' distinct terms, the
    result has their mean number / ``low`` entries at most.
    """
    counted = docs.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = written(counted, "terms")
    n = total.filter("term is null").first()
    if n is None or not n.n:
        return np.zeros(0, np.uint64)
    band = total.filter("term is not null").filter(F.col("n").between(max(2, low * n.n), max(2, high * n.n)))
    terms = band.select("term").toArrow().column("term").to_numpy()
    return np.sort(terms.view(np.uint64))


def fingerprints(data: np.ndarray, offsets: np.ndarray, lex: np.ndarray) -> np.ndarray:
    """A row of 32-bit subset hashes for each text; 0 where a subset has none of its terms."""
    n = len(offsets) - 1
    text, terms = distinct_terms(data, offsets)
    if len(lex):
        at = np.searchsorted(lex, terms)
        inside = lex[np.minimum(at, len(lex) - 1)] == terms
    else:
        inside = np.zeros(len(terms), bool)
    few = np.bincount(text[inside], minlength=n) < LEAST
    use = inside | few[text]
    text, terms = text[use], terms[use]
    out = np.zeros((n, len(SHARES) * EACH), np.uint32)
    for j in range(out.shape[1]):
        draw = words.mix(terms ^ np.uint64(0x5851F42D4C957F2D * (j + 1) % (1 << 64)))
        kept = draw < np.uint64(int(SHARES[j // EACH] * 2.0**64) - 1)
        # the sorted distinct terms, folded by a sum of their mixed values
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, text[kept], words.mix(draw[kept]))
        some = np.bincount(text[kept], minlength=n) > 0
        out[:, j] = np.where(some, (words.mix(sums) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), NONE)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted share of equal hashes among the subsets of which either has terms.

    A share whose subsets all have terms holds many of them, and any change spoils each; so
    every share weighs as its part of empty subsets. Texts too long for that are compared
    by the thinnest subsets, and two without any terms are alike.
    """
    some_a, some_b = a != NONE, b != NONE
    either, equal = some_a | some_b, (a == b) & some_a
    shape = (len(a), len(SHARES), EACH)
    weight = 1 - (some_a.reshape(shape).mean(axis=2) + some_b.reshape(shape).mean(axis=2)) / 2
    total = (either.reshape(shape).sum(axis=2) * weight).sum(axis=1)
    weight[total == 0] = np.eye(len(SHARES))[-1]
    total = (either.reshape(shape).sum(axis=2) * weight).sum(axis=1)
    hits = (equal.reshape(shape).sum(axis=2) * weight).sum(axis=1)
    alike = np.where(total > 0, hits / np.where(total > 0, total, 1), 1.0)
    return np.where((a == b).all(axis=1), 1.0, alike)


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.astype(">u4").tobytes().hex() for r in rows], pa.string())


# --- the edited texts of the query: each document with its successor's beginning at its end


PLACED = "range int, key long, tie long"


def _placed(marks: np.ndarray):
    """The first key of each range among this task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[int, int]] = {}
        for batch in batches:
            keys, ties = batch.column("key").to_pylist(), batch.column("tie").to_pylist()
            for r, key, tie in zip(np.searchsorted(marks, keys, "right").tolist(), keys, ties, strict=True):
                if r not in first or (key, tie) < first[r]:
                    first[r] = (key, tie)
        rows = [(r, *at) for r, at in first.items()]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["range", "key", "tie"]
            )

    return run


SQUEEZED = "doc_id long, range int, lent boolean, tie long, text binary"


def _squeezed(marks: np.ndarray, lend_to: dict[tuple[int, int], int]):
    """Each row with its range and compressed text; a range's first one also for another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in slices(whole, "text"):
                names = ("doc_id", "key", "tie", "text")
                rows = []
                for doc, key, tie, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    small = press.compress((text or "").encode())
                    rows.append((doc, int(np.searchsorted(marks, key, "right")), False, tie, small))
                    if (key, tie) in lend_to:
                        rows.append((doc, lend_to[key, tie], True, tie, small))
                kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "range", "lent", "tie", "text"],
                )

    return run


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edited(lex):
    """Rows sorted by range, own before lent, id: each but the range's last meets its successor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zlib.decompress(lex.value), np.uint64)
        press = zstandard.ZstdDecompressor()
        before = None  # (range, id, text) that waits for its successor
        pairs: list[tuple] = []
        held = 0

        def done() -> pa.RecordBatch:
            nonlocal pairs, held
            edits, sizes = [], []
            for _, text, follow in pairs:
                n = len(text)
                sizes.append(n)
                edits.append(text[: n - n // 4] + follow[: n // 4])
            m = len(pairs)
            prints = fingerprints(*flat(pa.array([p[1] for p in pairs] + edits + [p[2] for p in pairs], pa.large_string())), known)
            own, edited, follow = prints[:m], prints[m : 2 * m], prints[2 * m :]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]), _hex(own), _hex(edited),
                    pa.array(likeness(own, edited)), pa.array(likeness(own, follow)),
                ],
                names=[c.split()[0] for c in EDITED.split(", ")],
            )
            pairs, held = [], 0
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "lent", "doc_id", "text")]
            for where, lent, doc, squeezed in zip(*columns, strict=True):
                text = press.decompress(squeezed).decode()
                if before is not None and before[0] == where:
                    pairs.append((before[1], before[2], text))
                    held += len(text) + len(before[2])
                    if held > 1 << 20:
                        yield done()
                before = None if lent else (where, doc, text)
        if pairs:
            yield done()

    return run


def edited_likeness(docs: DataFrame, lex: np.ndarray, ranges: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the document's last quarter of code points replaced by as many of
    the next document's first (or all it has), by ascending id, the first again after the
    last. Null ids come last and repeated ones go by text hash; null texts count as empty.
    An empty table gives no rows; other columns are ignored. A lone document follows itself.

    Ids are cut into ranges at their quantiles; the first document of each range is also
    lent to the range before, so every pair of neighbours meets. Texts travel compressed.
    """
    spark = docs.sparkSession
    parts = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = source.select(key.alias("key"))
    marks = ids.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10_000).alias("m")).first().m
    marks = np.array(sorted({*(marks or [])}), np.int64)
    placed = source.select("doc_id", key.alias("key"), tie.alias("tie"), "text")
    heads = placed.select("key", "tie").mapInArrow(_placed(marks), PLACED)
    # one row a range
    heads = heads.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("head")).orderBy("range").collect()
    lend_to = {(h.head.key, h.head.tie): heads[i - 1].range for i, h in enumerate(heads)}
    squeezed = placed.mapInArrow(_squeezed(marks, lend_to), SQUEEZED)
    dealt = squeezed.repartition("range").sortWithinPartitions("range", "lent", F.asc_nulls_last("doc_id"), "tie")
    shared = spark.sparkContext.broadcast(zlib.compress(lex.tobytes(), 1))
    return dealt.mapInArrow(_edited(shared), EDITED)
