"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

A conversation's path is one fixed-size unit a turn: a 128-bit digest of role and text and the
text's length. Paths are sorted over the cluster and cut into shards. A shard writes its part
of the trie as balanced parentheses in depth-first order. A range min-max tree over blocks of
their excess finds the close of a node, which delimits its subtree; the rank of "()" counts
its leaves, and cumulative arrays give its members and savings. Only the nodes on a shard's
first and last path can go on in its neighbours. These spines, with what hangs off them summed
up, are the paths of the next level, which holds two for each shard, and so on until one shard
holds all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.frames import written

#: bytes of a turn in a path: digest and number of code points
UNIT = 20
#: paths, and bytes of paths, of one shard
SHARD, SHARD_BYTES = 1 << 15, 8 << 20
#: a shard has so many paths at least, so that levels shrink
LEAST = 16
#: parentheses of one block
BLOCK = 64

FIELDS = ("ends", "members", "leaves", "saved", "children", "least")
NEVER = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

PATHS = "path binary, tie long, sums binary"
PARTS = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends binary, node binary, parent binary, tie long, path binary, sums binary"
)
NAMES = [c.split()[0] for c in PARTS.split(", ")]


class Parentheses:
    """A balanced sequence with a range min-max tree over the excess of its blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = -(-len(bits) // BLOCK)
        self.width = 1 << max(0, blocks - 1).bit_length()
        padded = np.full(self.width * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.padded = padded.reshape(self.width, BLOCK)
        self.least = np.full(2 * self.width, np.iinfo(np.int64).max)
        self.least[self.width :] = self.padded.min(axis=1)
        for level in range(self.width.bit_length() - 2, -1, -1):
            at = 1 << level
            self.least[at : 2 * at] = np.minimum(self.least[2 * at : 4 * at : 2], self.least[2 * at + 1 : 4 * at : 2])
        pairs = bits[:-1] & ~bits[1:]
        #: leaf pairs that begin before each place
        self.pairs = np.concatenate([[0], np.cumsum(pairs), [int(pairs.sum())]])

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where the excess first falls below that of each opening parenthesis."""
        goal = self.excess[opens] - 1
        block = opens // BLOCK
        out = self._within(block, opens % BLOCK, goal)
        left = np.flatnonzero(out < 0)
        if len(left) == 0:
            return out
        goal, node, last = goal[left], block[left] + self.width, 2 * self.width - 1
        found, climbing = np.zeros(len(left), np.int64), np.ones(len(left), bool)
        while climbing.any():  # up, until a right neighbour's subtree has it
            hit = climbing & (node & 1 == 0) & (self.least[np.minimum(node + 1, last)] <= goal)
            found[hit] = node[hit] + 1
            climbing &= ~hit
            node = np.where(climbing, node >> 1, node)
        while (inner := found < self.width).any():  # down to the first block
            child = np.where(inner, 2 * found, found)
            found = np.where(inner, child + (self.least[child] > goal), found)
        out[left] = self._within(found - self.width, np.zeros(len(left), np.int64), goal)
        return out

    def _within(self, block: np.ndarray, start: np.ndarray, goal: np.ndarray) -> np.ndarray:
        out = np.empty(len(block), np.int64)
        for a in range(0, len(block), 4096):  # bounded memory
            b = slice(a, a + 4096)
            ok = (self.padded[block[b]] <= goal[b, None]) & (np.arange(BLOCK) >= start[b, None])
            out[b] = np.where(ok.any(axis=1), block[b] * BLOCK + ok.argmax(axis=1), -1)
        return out

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        return self.pairs[closes] - self.pairs[opens]


def shared_units(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // UNIT
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // UNIT


def node_keys(path: bytes) -> list[bytes]:
    """A key of each node on a path, the root first: digests of its prefixes, chained."""
    keys = [b"\\0" * 16]
    for a in range(0, len(path), UNIT):
        keys.append(hashlib.blake2b(keys[-1] + path[a : a + UNIT], digest_size=16).digest())
    return keys


@dataclass
class Trie:
    """The nodes of one shard in depth-first order, with what is known of each by itself."""

    depth: np.ndarray
    chars: np.ndarray
    parent: np.ndarray
    sums: np.ndarray  # one row a node: FIELDS
    first: list[int]  # nodes of the first path, of the last
    last: list[int]
    ids: list[list[int]]  # conversations that end at the node, ascending
    units: list[bytes]
    bits: np.ndarray

    @classmethod
    def of(cls, paths: list[bytes], ties: list[int], sums: list[bytes | None]) -> Trie:
        """From sorted paths. One without sums is a conversation; else ``sums`` has a row of
        FIELDS for each of the path's nodes."""
        depth, chars, parent, ids, units, bits = [0], [0], [-1], [[]], [b""], [True]
        stack, before = [0], b""
        at: list[int] = []
        whole: list[tuple[list[int], bytes]] = []
        first = None
        for path, tie, own in zip(paths, ties, sums, strict=True):
            keep = shared_units(before, path) if before else 0
            bits += [False] * (len(stack) - 1 - keep)
            del stack[keep + 1 :]
            for a in range(keep * UNIT, len(path), UNIT):
                parent.append(stack[-1])
                stack.append(len(depth))
                depth.append(len(stack) - 1)
                units.append(path[a : a + UNIT])
                chars.append(int.from_bytes(units[-1][16:], "big"))
                ids.append([])
                bits.append(True)
            if own is None:
                at.append(stack[-1])
                ids[stack[-1]].append(tie)
            else:
                whole.append((stack[:], own))
            if first is None:
                first = stack[:]
            before = path
        bits += [False] * len(stack)
        out = np.zeros((len(depth), len(FIELDS)), np.int64)
        out[:, 5] = NEVER
        if at:
            np.add.at(out[:, 0], at, 1)
            np.minimum.at(out[:, 5], at, [t for t, s in zip(ties, sums, strict=True) if s is None])
        for nodes, own in whole:
            rows = np.frombuffer(own, "<i8").reshape(-1, len(FIELDS))
            out[nodes, :5] += rows[:, :5]
            out[nodes, 5] = np.minimum(out[nodes, 5], rows[:, 5])
        return cls(np.array(depth), np.array(chars, np.int64), np.array(parent), out, first or [0], stack, ids, units, np.array(bits))

    def figures(self) -> dict[str, np.ndarray]:
        """Of every node: members, children, leaves, savings and the smallest member."""
        n = len(self.depth)
        shape = Parentheses(self.bits)
        opens = np.flatnonzero(self.bits)
        closes = shape.findclose(opens)
        end = np.arange(n) + (closes - opens + 1) // 2  # the subtree is the nodes from its top to here
        over = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[:-1]
        members = over(self.sums[:, 0] + self.sums[:, 1])
        children = np.bincount(self.parent[1:], minlength=n) + self.sums[:, 4]
        # a pair "()" is no leaf if children of it were closed below
        bare = np.flatnonzero((closes == opens + 1) & (self.sums[:, 4] > 0))
        hidden = np.zeros(n, np.int64)
        hidden[bare] = 1
        leaves = shape.leaves(opens, closes) - over(hidden) + over(self.sums[:, 2])
        saved = over((members - 1) * self.chars + self.sums[:, 3])
        least = self.sums[:, 5].tolist()
        up = self.parent.tolist()
        for v in range(n - 1, 0, -1):
            if least[v] < least[up[v]]:
                least[up[v]] = least[v]
        return {"members": members, "children": children, "leaves": leaves, "saved": saved, "least": np.array(least, np.int64)}


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def shard_rows(paths: list[bytes], ties: list[int], sums: list[bytes | None], whole: bool) -> Iterator[tuple]:
    """Rows of one shard in the columns of PARTS: finished nodes, ids that end on its spines,
    and its spines as paths of the next level. Where the shard is all there is (``whole``),
    every node is finished."""
    trie = Trie.of(paths, ties, sums)
    found = trie.figures()
    n = len(trie.depth)
    spine = np.zeros(n, bool)
    if not whole:
        spine[trie.first], spine[trie.last] = True, True
    keys = {}
    for nodes, path in ((trie.first, paths[0]), (trie.last, paths[-1])):
        keys.update(zip(nodes, node_keys(path), strict=True))
    least, up = found["least"].tolist(), trie.parent.tolist()
    columns = [found[c].tolist() for c in ("members", "children", "leaves", "saved")]
    upper = sums[0] is not None
    for v, (depth, members, children, leaves, saved) in enumerate(zip(trie.depth.tolist(), *columns, strict=True)):
        if upper and v not in keys:  # the parent comes before
            keys[v] = hashlib.blake2b(keys[up[v]] + trie.units[v], digest_size=16).digest()
        if spine[v]:
            continue
        p = up[v]
        open_above = p >= 0 and spine[p]
        # ids that end at a node of an upper level are looked up by its key
        ends = None if upper else hashlib.sha256(_joined(trie.ids[v])).hexdigest().encode()
        yield (
            "node", least[v], depth, None if p < 0 or open_above else least[p], members, children, leaves, saved,
            ends, keys[v] if upper else None, keys[p] if open_above else None, None, None, None,
        )
    if whole:
        return
    for v in sorted({*trie.first, *trie.last}):
        if trie.ids[v]:
            yield ("ends", None, None, None, None, None, None, None, _joined(trie.ids[v]), keys[v], None, trie.ids[v][0], None, None)
    # what hangs off a spine: its closed children's subtrees
    own = trie.sums.copy()
    closed = np.flatnonzero(~spine & spine[np.maximum(trie.parent, 0)] & (trie.parent >= 0))
    for column, values in ((1, found["members"]), (2, found["leaves"]), (3, found["saved"]), (4, np.ones(n, np.int64))):
        np.add.at(own[:, column], trie.parent[closed], values[closed])
    np.minimum.at(own[:, 5], trie.parent[closed], found["least"][closed])
    done = np.zeros(n, bool)
    for nodes, path in ((trie.first, paths[0]), (trie.last, paths[-1])):
        rows = own[nodes].copy()
        rows[done[nodes]] = (0, 0, 0, 0, 0, NEVER)
        if not done[nodes].all():
            yield ("path", None, None, None, None, None, None, None, None, None, None, int(rows[:, 5].min()), path, rows.astype("<i8").tobytes())
        done[nodes] = True


def _sharded(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[bytes] = []
        ties: list[int] = []
        sums: list[bytes | None] = []
        size = 0
        for batch in batches:
            for path, tie, own in zip(*(batch.column(c).to_pylist() for c in ("path", "tie", "sums")), strict=True):
                paths.append(path)
                ties.append(tie)
                sums.append(own)
                size += len(path) + len(own or b"")
                if not whole and (len(paths) >= SHARD or size >= SHARD_BYTES and len(paths) >= LEAST):
                    yield from _batches(shard_rows(paths, ties, sums, whole))
                    paths, ties, sums, size = [], [], [], 0
        if paths:
            yield from _batches(shard_rows(paths, ties, sums, whole))

    return run


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in PARTS.split(", ")]
    rows = list(rows)
    for first in range(0, len(rows), 4096):
        columns = zip(*rows[first : first + 4096], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a node over its ids, which come in ascending chunks; one chunk at a time in memory."""
    node, state = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        if out:
            yield _hashes(out)
    if node is not None:
        yield _hashes([(node, state.hexdigest())])


def _hashes(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values)], names=["node", "sha"])


def units(conversations: DataFrame) -> DataFrame:
    """``conv_id, units``: the turns of each conversation, by turn (null first), then role and
    text, as hexadecimal units of its path; a null role or text counts as empty.

    Rows without ``conv_id`` belong to no conversation. Texts are digested where they lie.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    unit = F.upper(F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.select("conv_id", F.row_number().over(order).alias("nth"), unit.alias("unit"))
    held = F.sort_array(F.collect_list(F.struct("nth", "unit")))
    return placed.groupBy("conv_id").agg(F.transform(held, lambda x: x.unit).alias("units"))


def rebuilt(own: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """``conv_id, units`` with a shared beginning: conversation ``c`` begins with the first
    ``h`` turns of conversation ``c - c % group`` (all if fewer, none if absent) and goes on with
    its own turns after its first ``h``, where ``h`` is the crc32 of its decimal id modulo
    ``most``."""
    head = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("units", 1, most - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(head, "base", "left").withColumn("h", h)
    begin = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(begin, F.slice("units", F.col("h") + 1, F.size("units"))).alias("units"))


def nodes(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths`` (``conv_id, units``); see :func:`prefix_nodes`."""
    level = written(
        paths.select(
            F.unhex(F.array_join("units", "")).alias("path"), F.col("conv_id").alias("tie"), F.lit(None).cast("binary").alias("sums")
        ),
        "paths",
    )
    tables: list[DataFrame] = []
    while True:
        size = F.sum(F.length("path") + F.coalesce(F.length("sums"), F.lit(0)))
        count, held = level.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
        whole = count <= SHARD and held <= 8 * SHARD_BYTES or count <= LEAST
        parts = max(1, -(-count // SHARD), -(-held // SHARD_BYTES))
        dealt = level.repartition(1) if whole else level.repartitionByRange(parts, "path", "tie")
        done = written(dealt.sortWithinPartitions("path", "tie").mapInArrow(_sharded(whole), PARTS), "trie")
        tables.append(done)
        if whole:
            break
        level = done.filter("kind = 'path'").select("path", "tie", "sums")
    found = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    text = F.col("ends").cast("string").alias("ends_sha256")
    low = tables[0].filter("kind = 'node'")
    if len(tables) == 1:
        return low.select(*found, text)
    ends = tables[0].filter("kind = 'ends'").select("node", "tie", "ends")
    hashes = ends.repartition("node").sortWithinPartitions("node", "tie").mapInArrow(_hashed, "node binary, sha string")
    upper = tables[1].filter("kind = 'node'")
    for more in tables[2:]:
        upper = upper.unionByName(more.filter("kind = 'node'"))
    upper = written(upper.select(*found, "node", "parent").join(hashes, "node", "left"), "spines")
    upper = upper.withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))
    every = low.select(*found, "parent", text).unionByName(upper.select(*found, "parent", "ends_sha256"))
    top = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    hung = every.filter("parent is not null").join(top, "parent").withColumn("parent_conv_id", F.col("above"))
    out = [*found, "ends_sha256"]
    return every.filter("parent is null").select(*out).unionByName(hung.select(*out))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of the ``conversations``
    (``conv_id, turn, role, text``), from the textless root on: ``conv_id`` (its smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` (a hash of the ids of the members that end there).

    Turns go by ``turn`` (null first), role and text. A null role or text counts as empty;
    rows without ``conv_id`` are left out; repeated rows are turns of their own. Texts are
    digested whole, so their length does not matter; one conversation's turns are sorted in
    one task, and its path, 20 bytes a turn, is one value. Equal conversations, however many,
    are dealt over shards. An empty table has no nodes; other columns are ignored.
    """
    return nodes(units(conversations))
