"""Language model: a probabilistic suffix tree over the bytes of normalised texts.

A text is its words, A-Z folded, with one blank between them and an end mark. The tree's
nodes are contexts of up to DEPTH bytes; one is kept where its next-byte distribution
diverges enough from that of the context one byte shorter, weighted by how often it occurs.
Distributions are smoothed towards the shorter context's, down to all bytes alike. Every
context that passes the test is kept. The model is sorted tables of what was seen behind each
context; each distinct run of DEPTH + 1 bytes of a batch is looked up once.

The tables are cut into SHARDS by a context's last byte. All shorter ends of a context have
the same last byte, so a shard answers for its contexts by itself. The driver makes and sends
one shard at a time, and a worker unpacks the shards it needs and keeps the newest.
"""

from __future__ import annotations

import pickle
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm import words
from stewardry.llm.frames import flat, remainder, slices, written
from stewardry.llm.imatch import Counts

DEPTH = 5
#: a context is kept if its divergence from the shorter one, times its count, is at least this (nats)
GAIN = 8.0
#: words whose counts are broadcast; the others' are joined
COMMON = 200_000
END, BLANK = 0, 0x20
#: parts of the model, by the last byte of a context
SHARDS = 32
#: bytes of unpacked shards that a worker keeps
UNPACKED = 256 << 20


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded words with a blank after each, the last one's being the end mark; bounds by text.

    A text without words is the end mark alone.
    """
    text, starts, ends = words.spans(data, offsets)
    n = len(offsets) - 1
    sizes = ends - starts + 1
    total = np.bincount(text, sizes, n).astype(np.int64)
    total[total == 0] = 1
    bounds = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(bounds[-1], np.uint8)
    if len(text):
        # every word goes as far behind its text's start as the words before it are long
        upto = np.cumsum(sizes) - sizes
        first = np.searchsorted(text, np.arange(n))
        base = upto[np.minimum(first, len(upto) - 1)]
        at = bounds[text] + upto - base[text]
        inner = words.IS_WORD[data]
        place = np.repeat(at - starts, ends - starts) + np.flatnonzero(inner)
        folded = words.LOWER[data[inner]]
        out[place] = np.where(folded == END, 1, folded)
        out[at + ends - starts] = BLANK
    out[bounds[1:] - 1] = END
    return out, bounds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's counts of words and of (DEPTH bytes, next byte), as 64-bit codes."""
    word_counts, gram_counts = Counts(), Counts()
    tokens = texts = 0
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            data, offsets = flat(batch.column("text"))
            _, h = words.hashed(data, offsets)
            word_counts.add(h)
            tokens += len(h) + batch.num_rows
            texts += batch.num_rows
            body, bounds = stream(data, offsets)
            gram_counts.add(grams(body, bounds))
    for kind, counts in (("word", word_counts), ("gram", gram_counts)):
        values, times = counts.total()
        for at in range(0, len(values), 100_000):
            part = values[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(kind, len(part)), pa.array(part.view(np.int64)), pa.array(times[at : at + 100_000])],
                names=["kind", "code", "n"],
            )
    yield pa.RecordBatch.from_arrays(
        [pa.array(["tokens", "texts"]), pa.array([0, 0], pa.int64()), pa.array([tokens, texts], pa.int64())], names=["kind", "code", "n"]
    )


def grams(body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Codes of every byte behind the DEPTH before it; before a text's start are end marks."""
    padded = np.zeros(len(body) + DEPTH * (len(bounds) - 1), np.uint64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(body)) + DEPTH * (text + 1)
    padded[at] = body
    code = np.zeros(len(body), np.uint64)
    for back in range(DEPTH, -1, -1):
        code = code << np.uint64(8) | padded[at - back]
    return code


@dataclass
class Level:
    """What follows the kept contexts of one length."""

    codes: np.ndarray  # context << 8 | byte seen behind it, sorted
    logp: np.ndarray  # base 10
    contexts: np.ndarray  # sorted
    left: np.ndarray  # log10 of the share that a byte not seen behind the context takes of the shorter one's


@dataclass
class Automaton:
    """Kept contexts by length; ``symbol`` maps bytes to symbols, the last one any byte not seen."""

    symbol: np.ndarray
    seen: int  # symbols without that last one
    levels: list[Level]

    def log10(self, codes: np.ndarray, longest: int = DEPTH) -> np.ndarray:
        """log10 probability of each code's last byte behind those before it, at most ``longest``."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for length in range(longest, -1, -1):
            level = self.levels[length]
            if not len(level.contexts):
                continue
            own = codes[open_] & np.uint64((1 << 8 * (length + 1)) - 1)
            at = np.minimum(np.searchsorted(level.codes, own), len(level.codes) - 1)
            hit = level.codes[at] == own
            out[open_[hit]] += level.logp[at[hit]]
            open_, own = open_[~hit], own[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(level.contexts, own), len(level.contexts) - 1)
            known = level.contexts[at] == own
            out[open_[known]] += level.left[at[known]]
        out[open_] -= np.log10(256)
        return out

    def size(self) -> int:
        return sum(x.nbytes for level in self.levels for x in (level.codes, level.logp, level.contexts, level.left))

    def _spelled_out(self) -> tuple[np.ndarray, np.ndarray]:
        """``move`` and ``logp`` by state and symbol, where states are the kept contexts and all
        their beginnings. To look at small models; scoring needs neither."""
        used = np.flatnonzero(self.symbol < self.seen).tolist()
        width = len(used) + 1
        kept = {int(c).to_bytes(8, "big")[8 - n :] for n, level in enumerate(self.levels) for c in level.contexts}
        order = sorted({c[:i] for c in kept for i in range(len(c) + 1)} | {b""}, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(order)}
        move, logp = np.zeros((len(order), width), np.int32), np.zeros((len(order), width), np.float32)
        unused = next((b for b in range(256) if b not in used), 0)
        for i, c in enumerate(order):
            for s, b in enumerate(used):
                goes = c + bytes((b,))
                move[i, s] = number[next(goes[k:] for k in range(len(goes) + 1) if goes[k:] in number)]
            codes = np.array([int.from_bytes(c + bytes((b,)), "big") for b in [*used, unused]], np.uint64)
            logp[i] = self.log10(codes, len(c))
        return move, logp

    @property
    def move(self) -> np.ndarray:
        return self._spelled_out()[0]

    @property
    def logp(self) -> np.ndarray:
        return self._spelled_out()[1]


def build(rows) -> Automaton:
    """The automaton of kept contexts from rows ``(length, context, next byte, count)``.

    A context is a number of its bytes, the last one lowest. Distributions are smoothed by
    Witten and Bell.
    """
    lengths, contexts, byte, n = np.asarray(rows, np.int64).reshape(-1, 4).T
    used = sorted({*np.unique(byte).tolist(), END, BLANK})
    symbol = np.full(256, len(used), np.int64)
    symbol[used] = np.arange(len(used))
    none = np.zeros(0, np.uint64)
    a = Automaton(symbol, len(used), [Level(none, np.zeros(0), none, np.zeros(0)) for _ in range(DEPTH + 1)])
    for length in range(DEPTH + 1):  # shorter contexts first
        own = lengths == length
        code = (contexts[own] << 8 | byte[own]).astype(np.uint64)
        if not len(code):
            continue
        order = np.argsort(code)
        code, times = code[order], n[own][order]
        kept, first, kinds = np.unique(code >> np.uint64(8), return_index=True, return_counts=True)
        total = np.add.reduceat(times, first) + kinds
        below = 10.0 ** a.log10(code, length - 1)
        p = (times + np.repeat(kinds, kinds) * below) / np.repeat(total, kinds)
        a.levels[length] = Level(code, np.log10(p).astype(np.float32), kept, np.log10(kinds / total).astype(np.float32))
    return a


class Shards:
    """The shards of a model in a worker: unpacked when first needed, the least recently used
    given up beyond UNPACKED bytes."""

    def __init__(self, packed: list):
        self.packed, self.held = packed, OrderedDict()

    def _shard(self, s: int) -> Automaton:
        if s in self.held:
            self.held.move_to_end(s)
        else:
            self.held[s] = pickle.loads(zlib.decompress(self.packed[s].value))
            while len(self.held) > 1 and sum(a.size() for a in self.held.values()) > UNPACKED:
                self.held.popitem(last=False)
        return self.held[s]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        own = shard_of(codes)
        for s in np.unique(own).tolist():
            mine = own == s
            out[mine] = self._shard(s).log10(codes[mine])
        return out


def shard_of(codes: np.ndarray) -> np.ndarray:
    """The shard of the contexts of ``codes`` (context, then the byte behind it)."""
    return ((codes >> np.uint64(8)) & np.uint64(255)).astype(np.int64) % SHARDS


def score_texts(a: Automaton | Shards, body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each text, its end mark included."""
    if len(bounds) < 2:
        return np.zeros(0)
    distinct, which = np.unique(grams(body, bounds), return_inverse=True)
    return np.add.reduceat(a.log10(distinct)[which], bounds[:-1])


@dataclass
class Model:
    shards: list  # broadcast, one Automaton packed in each
    contexts: DataFrame  # length, context, byte, n of what was kept
    common: np.ndarray  # hashes of common words, sorted
    counts: np.ndarray
    total: int  # tokens learned from
    distinct: int
    texts: int  # learned from; the count of the end mark
    words: DataFrame  # code, n of every word learned from

    @property
    def automaton(self) -> Automaton:
        """The whole model in one piece, to look at small ones."""
        return build(_rows(self.contexts))

    @property
    def base(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))


def _mask(length: Column) -> Column:
    """The bits of that many bytes."""
    return F.array(*[F.lit((1 << 8 * i) - 1).cast("bigint") for i in range(DEPTH + 1)])[length]


def _kept_contexts(found: DataFrame, gain: float) -> DataFrame:
    """``length, context, byte, n`` of the contexts that a divergence test retains, and of
    every shorter end of theirs."""
    byte, context = F.col("code").bitwiseAND(F.lit(255)), F.shiftright("code", 8)
    ends = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    rows = found.select(byte.alias("byte"), context.alias("all"), "n", ends.alias("length"))
    rows = rows.select("length", F.col("all").bitwiseAND(_mask(F.col("length"))).alias("context"), "byte", "n")
    rows = written(rows.groupBy("length", "context", "byte").agg(F.sum("n").alias("n")), "contexts")
    totals = rows.groupBy("length", "context").agg(F.sum("n").alias("total"))
    full = rows.join(totals, ["length", "context"])
    up = _mask(F.col("length") - 1)
    child = full.filter("length > 0 and total >= 8").withColumn("over", F.col("context").bitwiseAND(up)).withColumn("above", F.col("length") - 1)
    parent = full.select(
        F.col("length").alias("above"), F.col("context").alias("over"), "byte",
        F.col("n").alias("pn"), F.col("total").alias("ptotal"),
    )
    term = F.col("n") * F.log((F.col("n") * F.col("ptotal")) / (F.col("total") * F.col("pn")))
    tested = (
        child.join(parent, ["above", "over", "byte"]).groupBy("length", "context").agg(F.sum(term).alias("gain"))
        .filter(F.col("gain") >= gain)
    )
    chosen = tested.select(F.explode(F.sequence(F.lit(0), "length")).alias("length"), F.col("context").alias("all"))
    chosen = chosen.select("length", F.col("all").bitwiseAND(_mask(F.col("length"))).alias("context")).distinct()
    root = rows.filter("length = 0")
    return rows.filter("length > 0").join(chosen, ["length", "context"], "left_semi").unionByName(root)


def _rows(contexts: DataFrame) -> np.ndarray:
    rows = contexts.select("length", "context", "byte", "n").toArrow()
    return np.column_stack([rows.column(c).to_numpy().astype(np.int64) for c in rows.column_names])


def _packed_shards(contexts: DataFrame) -> list:
    """One shard after another: the driver holds the kept contexts of one at a time."""
    context, root = contexts.sparkSession.sparkContext, _rows(contexts.filter("length = 0"))  # 256 rows at most
    out = []
    for s in range(SHARDS):
        own = contexts.filter((F.col("length") > 0) & (F.col("context").bitwiseAND(F.lit(255)) % SHARDS == s))
        shard = build(np.concatenate([root, _rows(own)]))
        out.append(context.broadcast(zlib.compress(pickle.dumps(shard), 1)))
    return out


def learn(docs: DataFrame, gain: float = GAIN, common: int = COMMON) -> Model:
    """A model of the documents whose id's remainder by 5 is not 1, all of them, whole texts.

    A null text counts as empty, a null id as an empty one; repeated rows count as often as
    they are there; no rows give a model of nothing. Other columns are ignored.
    """
    texts = docs.filter(remainder("doc_id", 5) != 1).select("text")
    counted = texts.mapInArrow(_counted, "kind string, code long, n long")
    counted = written(counted.groupBy("kind", "code").agg(F.sum("n").alias("n")), "counts")
    vocabulary = counted.filter("kind = 'word'").select("code", "n")
    totals = {r.kind: r.n for r in counted.filter("kind in ('tokens', 'texts')").collect()}
    total, texts_learned = totals.get("tokens", 0), totals.get("texts", 0)
    size = vocabulary.count()
    # the least count at which no more than ``common`` words are left, from counts of counts
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    levels = vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    held, least = 0, None
    for row in levels:
        if held + row.words > common:
            break
        held, least = held + row.words, row.level
    few = vocabulary.filter(level >= least) if least is not None else vocabulary.limit(0)
    table = few.toArrow()
    code, n = table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(code)
    kept = written(_kept_contexts(counted.filter("kind = 'gram'"), gain), "kept")
    # the end mark is a token too
    distinct = size + (1 if texts_learned else 0)
    return Model(_packed_shards(kept), kept, code[order], n[order], total, distinct, texts_learned, vocabulary)


PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word long, uses long"


def _scored(packed: list, shared, end_count: float, log_total: float):
    """A row for every document with what is known here, and one for each of its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = pickle.loads(zlib.decompress(shared.value))
        automaton = Shards(packed)
        value = np.log10(counts + 0.5)
        names = [c.split()[0] for c in PARTS.split(", ")]
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                data, offsets = flat(batch.column("text"))
                m = batch.num_rows
                text, h = words.hashed(data, offsets)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    hit = common[at] == h
                else:
                    at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                n_tokens = np.bincount(text, minlength=m) + 1
                base = np.full(m, np.log10(end_count + 0.5)) - n_tokens * log_total
                if len(common):
                    base += np.bincount(text[hit], value[at[hit]], m)
                known = np.bincount(text[hit], minlength=m) + (1 if end_count else 0)
                score = score_texts(automaton, *stream(data, offsets))
                rows = batch.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens.astype(np.int64)),
                        pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                    ],
                    names=names,
                )
                rare_text, rare = text[~hit], h[~hit]
                if len(rare):
                    order = np.lexsort((rare, rare_text))
                    rare_text, rare = rare_text[order], rare[order]
                    head = np.ones(len(rare), bool)
                    head[1:] = (rare[1:] != rare[:-1]) | (rare_text[1:] != rare_text[:-1])
                    first = np.flatnonzero(head)
                    uses = np.diff(np.append(first, len(rare)))
                    k = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows[rare_text[first]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()),
                            pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()),
                            pa.array(rare[first].view(np.int64)), pa.array(uses.astype(np.int64)),
                        ],
                        names=names,
                    )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    A null text counts as empty: its end mark is its only token. Repeated rows give
    repeated results, an empty table none; other columns are ignored. The shards of the kept
    contexts and the common words' counts (at most COMMON) come with the model; the rest of the
    words are joined, one row for each document and word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps((model.common, model.counts)), 1))
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        (remainder("doc_id", 5) == 1).alias("held_out"), "text",
    )
    parts = written(source.mapInArrow(_scored(model.shards, shared, float(model.texts), model.base), PARTS), "scored")
    rare = parts.filter("word is not null").select("row", "word", "uses")
    counts = model.words.select(F.col("code").alias("word"), "n")
    more = (
        rare.join(counts, "word", "left")
        .select("row", (F.col("uses") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("b"), F.when(F.col("n") > 0, F.col("uses")).alias("k"))
        .groupBy("row").agg(F.sum("b").alias("b"), F.sum("k").alias("k"))
    )
    return parts.filter("word is null").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), "score",
    )
