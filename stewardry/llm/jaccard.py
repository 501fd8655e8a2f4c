"""Exact Jaccard join of word-shingle sets by signature trees.

Documents with the same shingle set form one class. Two linked classes share several of
their rarest shingles, so classes meet in the blocks of those, and a class that meets
others too seldom is linked to none. Links come from signature trees alone: a node holds the
OR of its sets' bitmaps, their size range and the most collisions; a dual traversal drops
node pairs whose greatest possible overlap is too small, whose sizes are too far apart or
whose classes are connected already, and compares the sets of what is left.

Trees are built twice. First each class goes to one tree, that of the family of the class it
meets most, so that every set moves once however large the group. Then the blocks that
still hold several components get trees of their own, which makes the components exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm import words
from stewardry.llm.components import components
from stewardry.llm.frames import flat, held, slices, unused, written

WIDTH = 5
#: cells of the shingle counts that order shingles from rare to common; any order is exact
CELLS = 1 << 22
SLICE = 1 << 14
#: bits of the filter that tells which classes' sets are wanted; a full one only wants more
FILTER = 1 << 25
FILTER_SLICE = 1 << 16
#: classes of one side that are compared in one task at once
TILE = 1024
#: classes of one family's tree; a larger family gets several, each with the class it is named after
FAMILY = 128
#: linked classes share a shingle among their rarest fifth, and one more of each 20 beyond it
EXTRA = 20
FANOUT = 8
#: what names a tree: a class, a band of sizes (of a family: one of its trees), two tiles
BLOCK = ("head", "band", "i", "j")


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * inter >= 80 * (a + b - inter)


def _class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, set size and class of every document, then this task's shingle counts."""
    cells = np.zeros(CELLS, np.int32)
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = words.shingle_sets(*flat(batch.column("text")), WIDTH)
            if sum(map(len, sets)):
                every = np.concatenate(sets)
                cells += np.bincount((every & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_of(s) for s in sets], pa.int64()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ],
                names=["doc_id", "n", "cls", "part", "cells"],
            )
    for part in range(CELLS // SLICE):
        own = cells[part * SLICE : (part + 1) * SLICE]
        if own.any():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                    pa.array([part], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary()),
                ],
                names=["doc_id", "n", "cls", "part", "cells"],
            )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each part, as logarithms of one byte."""
    part, total = None, np.zeros(SLICE, np.int64)

    def done() -> pa.RecordBatch:
        ranks = np.minimum(255, np.round(np.log2(1 + total) * 6)).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], names=["part", "ranks"]
        )

    for batch in batches:
        for p, c in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            if p != part:
                if part is not None:
                    yield done()
                part, total = p, np.zeros(SLICE, np.int64)
            total += np.frombuffer(zlib.decompress(c), np.int32)
    if part is not None:
        yield done()


def must_share(n: Column) -> Column:
    """How many signature shingles a class of size ``n`` shares with any linked class, at least."""
    return 1 + F.floor(F.ceil(n * 4 / 5) / EXTRA)


def _signatures(ranks):
    """The rarest shingles of each class, in a common order.

    A linked class of size m holds 0.8 of the larger size. Two sets that overlap in t
    share k of their n - t + k first shingles. So with the first n - ceil(0.8 n) + 1 + n / EXTRA
    linked classes share 1 + min(n, m) / EXTRA, and one with n - ceil(0.8 n) + 1; those
    are marked in the lowest bit of the size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(zlib.decompress(ranks.value), np.uint8)
        seen: set[int] = set()  # classes of this task's own documents
        for whole in batches:
            for batch in slices(whole, "text"):
                toks, classes, sizes = [], [], []
                for s in words.shingle_sets(*flat(batch.column("text")), WIDTH):
                    n = len(s)
                    cls = _class_of(s)
                    if n == 0 or cls in seen:
                        continue
                    seen.add(cls)
                    core = n - -(-4 * n // 5) + 1
                    first = min(n, core + n // EXTRA)
                    rank = order[(s & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
                    key = rank << np.uint64(56) | s >> np.uint64(8)
                    toks.append(s[np.argpartition(key, (core - 1, first - 1))[:first]])
                    classes.append(np.full(first, cls))
                    size = np.full(first, 2 * n)
                    size[:core] += 1
                    sizes.append(size)
                if toks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))],
                        names=["tok", "cls", "n"],
                    )

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, size and class: those of shingles with several classes,
    each with the block's first class and the one before it."""
    names = ["tok", "cls", "n"]
    carry = np.zeros((3, 0), np.int64)  # the last row, whose successor is not known yet
    first_cls, first_n, before, joined = 0, 0, 0, False  # of its block; whether it has a predecessor

    def emit(rows: np.ndarray, last: bool) -> pa.RecordBatch | None:
        nonlocal carry, first_cls, first_n, before, joined
        tok, cls, n = rows
        m = len(tok)
        fresh = np.ones(m, bool)
        fresh[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])  # repeated by another task
        tok, cls, n = tok[fresh], cls[fresh], n[fresh]
        m = len(tok)
        head = np.ones(m, bool)
        head[1:] = tok[1:] != tok[:-1]
        if joined:
            head[0] = False
        at = np.maximum.accumulate(np.where(head, np.arange(m), -1))
        lead = np.where(at >= 0, cls[at], first_cls)
        lead_n = np.where(at >= 0, n[at], first_n)
        prev = np.concatenate([[before], cls[:-1]])
        follow = np.zeros(m, bool)
        follow[:-1] = ~head[1:]
        use = ~head | follow
        stop = m if last else m - 1
        if not last:
            joined = bool(not head[-1])
            first_cls, first_n, before = int(lead[-1]), int(lead_n[-1]), int(prev[-1])
            carry = np.array([[tok[-1]], [cls[-1]], [n[-1]]])
        use[stop:] = False
        if not use.any():
            return None
        far = 4 * (n >> 1) > 5 * (lead_n >> 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(tok[use]), pa.array(cls[use]), pa.array(n[use] >> 1), pa.array((n[use] & 1) == 1), pa.array(np.where(far, prev, lead)[use], mask=head[use]), pa.array(prev[use], mask=head[use])],
            names=[*names, "core", "lead", "prev"],
        )

    for batch in batches:
        if batch.num_rows:
            rows = np.stack([batch.column(c).to_numpy() for c in names])
            out = emit(np.concatenate([carry, rows], axis=1), False)
            if out is not None:
                yield out
    if carry.shape[1]:
        out = emit(carry, True)
        if out is not None:
            yield out


def _places(cls: np.ndarray) -> np.ndarray:
    """The two bits of each class in the filter."""
    h = cls.view(np.uint64)
    return np.concatenate([h & np.uint64(FILTER - 1), (h >> np.uint64(32)) & np.uint64(FILTER - 1)]).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's part of the filter."""
    bits = np.zeros(FILTER, bool)
    for batch in batches:
        bits[_places(batch.column("cls").to_numpy())] = True
    for part in range(FILTER // FILTER_SLICE):
        own = bits[part * FILTER_SLICE : (part + 1) * FILTER_SLICE]
        if own.any():
            packed = zlib.compress(np.packbits(own).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "bits"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' filters put together, part by part as they come."""
    part, total = None, np.zeros(FILTER_SLICE // 8, np.uint8)
    for batch in batches:
        for p, b in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            if p != part and part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()])], names=["part", "bits"])
                total = np.zeros(FILTER_SLICE // 8, np.uint8)
            part = p
            total |= np.frombuffer(zlib.decompress(b), np.uint8)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()])], names=["part", "bits"])


def _arrays(wanted):
    """The sets of wanted classes, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(wanted.value), np.uint8)).view(bool)
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                found = {}
                for s in words.shingle_sets(*flat(batch.column("text")), WIDTH):
                    cls = _class_of(s)
                    if len(s) and cls not in seen and bits[_places(np.array([cls]))].all():
                        seen.add(cls)
                        found[cls] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*found], pa.int64()), pa.array([*found.values()], pa.binary())], names=["cls", "shingles"]
                )

    return run


def _sets_of(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The ``needed`` classes (``cls`` and more) with their ``shingles``.

    A filter of fixed size, sent to the tasks, keeps nearly all other sets from the
    shuffle; the join behind it is exact.
    """
    parts = needed.select("cls").mapInArrow(_marked, "part int, bits binary")
    parts = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_joined, "part int, bits binary")
    bits = np.zeros(FILTER // 8, np.uint8)
    for r in parts.toLocalIterator():  # FILTER bits in all
        at = r.part * (FILTER_SLICE // 8)
        bits[at : at + FILTER_SLICE // 8] = np.frombuffer(r.bits, np.uint8)
    wanted = texts.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))
    found = texts.select("text").mapInArrow(_arrays(wanted), "cls long, shingles binary")
    return found.dropDuplicates(["cls"]).join(needed, "cls")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


class SignatureTree:
    """Levels of OR-combined bitmaps over sets that are given from similar to dissimilar."""

    def __init__(self, sets: list[np.ndarray], comps: np.ndarray):
        n = len(sets)
        sizes = np.array([len(s) for s in sets])
        bits = 1 << int(np.clip(np.ceil(np.log2(8 * sizes.max())), 9, 16))
        packed = np.empty((n, bits // 64), np.uint64)
        for i, s in enumerate(sets):
            row = np.zeros(bits, bool)
            row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            packed[i] = np.packbits(row).view(np.uint64)
        lost = sizes - np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        #: per level, leaves first: bitmap, least and greatest size, most collisions, component or -1
        self.levels = [(packed, sizes, sizes, lost, comps)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, lost, comp = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            same = np.minimum.reduceat(comp, at) == np.maximum.reduceat(comp, at)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                 np.maximum.reduceat(lost, at), np.where(same, comp[at], -1))
            )

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs (x < y) that may be linked and are not known to be connected."""
        x = y = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            maps, low, high, lost, comp = self.levels[depth]
            if depth < len(self.levels) - 1:
                step = np.arange(FANOUT)
                x, y = (
                    (x[:, None, None] * FANOUT + step[None, :, None] + 0 * step[None, None, :]).ravel(),
                    (y[:, None, None] * FANOUT + 0 * step[None, :, None] + step[None, None, :]).ravel(),
                )
                there = (y < len(maps)) & (x <= y)
                x, y = x[there], y[there]
            if depth == 0:
                x, y = x[x < y], y[x < y]
            may = (5 * high[x] >= 4 * low[y]) & (5 * high[y] >= 4 * low[x])
            may &= (comp[x] < 0) | (comp[x] != comp[y])
            x, y = x[may], y[may]
            keep = np.empty(len(x), bool)
            for a in range(0, len(x), 4096):
                p, q = x[a : a + 4096], y[a : a + 4096]
                common = np.bitwise_count(maps[p] & maps[q]).sum(axis=1, dtype=np.int64)
                most = common + np.minimum(lost[p], lost[q])
                keep[a : a + 4096] = 9 * most >= 4 * (low[p] + low[q])
            x, y = x[keep], y[keep]
        return x, y


def _block_links(classes: np.ndarray, comps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """What the links of one block's classes connect anew, as stars: the smallest class of a
    connected group with each class that a link joined to it.

    ``sides``: bit 1 and 2 for the two tiles; two rows are compared if one is of each. Stars
    instead of the links themselves leave shorter chains to :func:`components`.
    """
    number = np.unique(comps, return_inverse=True)[1]
    # similar sets often share their least shingle, so it brings members and components together
    least = np.array([s[0] for s in sets])
    first = np.full(int(number.max()) + 1, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(first, number, least)
    order = np.lexsort((least, number, first[number]))
    tree = SignatureTree([sets[i] for i in order], number[order])
    root = list(range(int(number.max()) + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ends: list[int] = []  # rows that a link joined
    for p, q in zip(*tree.pairs(), strict=True):
        i, j = order[p], order[q]
        if not (sides[i] & 1 and sides[j] & 2 or sides[i] & 2 and sides[j] & 1):
            continue
        u, v = find(int(number[i])), find(int(number[j]))
        if u != v and linked(overlap(sets[i], sets[j]), len(sets[i]), len(sets[j])):
            root[v] = u
            ends += [int(i), int(j)]
    least: dict[int, int] = {}
    for i in ends:
        u, own = find(int(number[i])), int(classes[i])
        least[u] = min(own, least.get(u, own))
    return sorted({(least[find(int(number[i]))], int(classes[i])) for i in ends if classes[i] != least[find(int(number[i]))]})


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks that come one after another, each of a bounded number of classes."""
    key, rows = None, []

    def links() -> Iterator[pa.RecordBatch]:
        merged: dict[int, list] = {}
        for cls, comp, side, s in rows:
            merged.setdefault(cls, [comp, 0, s])[1] |= side
        if len(merged) < 2:
            return
        found = _block_links(
            np.array([*merged]), np.array([m[0] for m in merged.values()]), np.array([m[1] for m in merged.values()]),
            [np.frombuffer(m[2], np.uint64) for m in merged.values()],
        )
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
            )

    for whole in batches:
        for batch in slices(whole, "shingles"):
            columns = [batch.column(c).to_pylist() for c in (*BLOCK, "cls", "comp", "side", "shingles")]
            for head, band, i, j, cls, comp, side, s in zip(*columns, strict=True):
                if (head, band, i, j) != key:
                    if rows:
                        yield from links()
                    key, rows = (head, band, i, j), []
                rows.append((cls, comp, side, s))
    if rows:
        yield from links()


def _tree_links(dealt: DataFrame) -> DataFrame:
    """``a, b``: what the trees of ``dealt`` (a block's key, ``cls, comp, side, shingles``) connect."""
    return dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(_trees, "a long, b long")


def _homes(needed: DataFrame, size: int) -> DataFrame:
    """``cls, family, tiles, leads``: the family of each class, the trees this is cut into, and
    those of the family that is named after the class (null: there is none).

    The family is named after the class met most (``lead``), or the smaller of two that meet
    each other most.
    """
    back = needed.select(F.col("cls").alias("lead"), F.col("lead").alias("back"))
    name = F.when(F.col("back") == F.col("cls"), F.least("cls", "lead")).otherwise(F.col("lead"))
    own = needed.join(back, "lead", "left").select("cls", name.alias("family"))
    sizes = own.groupBy("family").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles"))
    led = sizes.select(F.col("family").alias("cls"), F.col("tiles").alias("leads"))
    return own.join(sizes, "family").join(led, "cls", "left")


def _family_blocks(sets: DataFrame) -> DataFrame:
    """One row per class in its family's tree, and the class a family is named after in each of them."""
    own = F.pmod(F.xxhash64("cls"), F.col("tiles").cast("bigint")).cast("int")
    members = sets.select(F.col("family").alias("head"), own.alias("band"), "cls", "shingles")
    leads = sets.filter("leads > 1 or leads = 1 and family <> cls")
    leads = leads.select(F.col("cls").alias("head"), F.explode(F.sequence(F.lit(0), F.col("leads") - 1)).alias("band"), "cls", "shingles")
    rows = members.unionByName(leads)
    return rows.select("head", "band", F.lit(0).alias("i"), F.lit(0).alias("j"), "cls", F.col("cls").alias("comp"), F.lit(3).alias("side"), "shingles")


def _often(members: DataFrame) -> DataFrame:
    """Rows of classes that are in as many of the blocks as a linked class has to be."""
    often = members.groupBy("cls").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    return members.join(often.filter(F.col("k") >= must_share(F.col("n"))), "cls", "left_semi")


def _open_blocks(members: DataFrame, comp: DataFrame, tile: int) -> DataFrame:
    """Rows of blocks with classes of several components, dealt out in pairs of tiles.

    Blocks are cut by size (linked sets lie in the same or neighbouring bands of a factor
    1.25), blocks with the same smallest class are put together, since they mostly hold
    the same family, and a large one becomes tile pairs.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + F.lit(1e-9)).cast("int")
    rows = members.select("tok", "cls", "n", "core").join(comp.withColumnsRenamed({"node": "cls", "root": "comp"}), "cls", "left")
    rows = rows.withColumn("comp", F.coalesce("comp", "cls"))
    open_ = rows.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    rows = _often(rows.join(open_, "tok", "left_semi")).filter("core")
    rows = written(rows.select("tok", "cls", "comp", band.alias("own")), "open")
    dealt = rows.select(
        "tok", "cls", "comp",
        F.explode(F.array(
            F.struct(F.col("own").alias("band"), F.lit(1).alias("up")),
            F.struct((F.col("own") - 1).alias("band"), F.lit(2).alias("up")),
        )).alias("x"),
    ).select("tok", "x.band", "cls", "comp", "x.up")
    blocks = (
        dealt.groupBy("tok", "band")
        .agg(F.min("cls").alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("up").alias("least"))
        .filter("lo <> hi and least = 1").select("tok", "band", "head")
    )
    together = written(dealt.join(blocks, ["tok", "band"]).select("head", "band", "cls", "comp").distinct(), "families")
    sizes = together.groupBy("head", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    kept = together.join(sizes, ["head", "band"])
    own_tile = F.pmod(F.xxhash64("cls"), F.col("tiles").cast("bigint")).cast("int")
    # a tile meets every other tile once and itself once
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = kept.withColumn("t", own_tile).withColumn("u", other)
    return pairs.select(
        "head", "band", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "cls", "comp",
        F.when(F.col("t") == F.col("u"), 3).when(F.col("t") < F.col("u"), 1).otherwise(2).alias("side"),
    )


def jaccard_components(docs: DataFrame, tile: int = TILE, family: int = FAMILY) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    Two texts link when 100 * common shingles >= 80 * all shingles of five words, A-Z folded;
    a text of fewer words is one shingle. A null, empty or blank text has none and is a
    component by itself. The component id is the smallest doc_id reachable; null ids count
    last and get the component of their text. Repeated rows give repeated results, an
    empty table none; other columns are ignored. Sets are compared by 64-bit hashes of
    their shingles.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = written(texts.mapInArrow(_sets, "doc_id long, n long, cls long, part int, cells binary"), "sets")
    rows = sets.filter("part is null").select("doc_id", "n", "cls")
    counts = sets.filter("part is not null").select("part", "cells").repartition("part").sortWithinPartitions("part")
    ranks = np.zeros(CELLS, np.uint8)
    for r in counts.mapInArrow(_added, "part int, ranks binary").toLocalIterator():  # CELLS bytes in all
        ranks[r.part * SLICE : (r.part + 1) * SLICE] = np.frombuffer(r.ranks, np.uint8)
    order = spark.sparkContext.broadcast(zlib.compress(ranks.tobytes(), 1))

    signatures = texts.select("text").mapInArrow(_signatures(order), "tok long, cls long, n long")
    sorted_ = signatures.repartition("tok").sortWithinPartitions("tok", "n", "cls")
    met = "tok long, cls long, n long, core boolean, lead long, prev long"
    with held(sorted_.mapInArrow(_members, met), "blocks") as blocks:
        members = written(_often(blocks), "members")

    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    votes = members.filter("lead is not null").select("cls", F.explode(F.array("lead", "prev")).alias("other"))
    votes = votes.groupBy("cls", "other").agg(F.count("*").alias("k"))
    best = votes.groupBy("cls").agg(F.max(F.struct("k", F.col("other"))).alias("v"))
    needed = members.select("cls").distinct().join(best, "cls", "left").select("cls", F.coalesce("v.other", "cls").alias("lead"))
    with held(needed, "needed") as met_most, held(_homes(met_most, family), "homes") as homes:
        arrays = written(_sets_of(texts, homes), "shingles")
    easy = written(_tree_links(_family_blocks(arrays)), "easy")
    first = written(components(easy), "first")

    dealt = _open_blocks(members, first, tile)
    hard = written(_tree_links(dealt.join(arrays.select("cls", "shingles"), "cls")), "hard")
    # the first round's stars and the new links connect what either connects
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(hard))

    named = classes.join(roots.withColumnsRenamed({"node": "cls"}), "cls", "left")
    named = named.select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component"))
    by_class = named.join(lowest, "root").select("cls", "component")
    some = rows.filter("n > 0").join(by_class, "cls").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return some.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of every group of linked documents the row whose id names it, with all columns.

    Rows without an id stay; of rows that repeat an id, all that carry their group's id do.
    """
    named, own = jaccard_components(docs), unused("_llm_stay", docs.columns)
    stay = named.filter("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stay, F.col("doc_id").cast("bigint").eqNullSafe(F.col(own)), "left_semi")
