"""Ranked lexical search: accumulator-limited term-at-a-time over the shards of an index.

The index holds, for each shard of documents, the posting lists of the terms that the
queries name. A query's terms are taken rarest first. Each adds its impact to the documents
it is found in; documents met for the first time get an accumulator only as long as what the
remaining terms could add at most reaches the kth partial score so far. From then on the
remaining terms update the accumulators there are, exactly. The kth score is carried from one
shard of a task to the next, so later shards open fewer accumulators.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm import words
from stewardry.llm.frames import flat, slices, written

#: pairs of a query and one of its terms that one block of queries has at most, but for a
#: single query with more
BLOCK = 1 << 17
#: best documents of one task are first compared within so many parts of a query's tasks
PARTS = 64

_TERM = np.ones(256, bool)
_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False

INDEX = "terms long, texts long, doc_id array<long>, sizes array<long>, code array<int>, df array<long>, doc array<int>, tf array<int>"
HITS = "query int, task int, doc_id long, score long"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Text number and folded bytes of every term: a maximal run of ASCII letters, digits and
    characters beyond ASCII."""
    n = len(data)
    inside = _TERM[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    limits = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    body = words.LOWER[data[inside]]
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(limits), pa.py_buffer(body)])
    return np.searchsorted(offsets, starts, "right") - 1, spelled


def _indexed(vocabulary: list[bytes]):
    """One row a shard: its documents' sizes and the posting lists of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for whole in batches:
            for batch in slices(whole, "text"):
                text, spelled = terms(*flat(batch.column("text")))
                sizes = np.bincount(text, minlength=batch.num_rows)
                code = pc.fill_null(pc.index_in(spelled, known), -1).to_numpy(zero_copy_only=False)
                met = code >= 0
                pair, tf = np.unique(code[met].astype(np.int64) * batch.num_rows + text[met], return_counts=True)
                term, doc = pair // batch.num_rows, pair % batch.num_rows
                there, df = np.unique(term, return_counts=True)
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(sizes.sum())]), pa.array([int((sizes > 0).sum())]),
                        pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), one(sizes, pa.int64()),
                        one(there, pa.int32()), one(df, pa.int64()), one(doc, pa.int32()), one(tf, pa.int32()),
                    ],
                    names=[c.split()[0] for c in INDEX.split(", ")],
                )

    return run


@dataclass
class Figures:
    """What scoring needs of all documents: how many have terms, all their terms, and a weight a term."""

    texts: int
    terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array(
            [math.floor(1000 * math.log((2 * self.texts + 2) / (2 * int(df) + 1))) for df in self.df], np.int64
        )


def _best(score: np.ndarray, doc: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: highest score, then smallest document, one without an id last."""
    return np.lexsort((doc, missing, -score))[:k]


class Search:
    """The ``k`` best documents of each query over the shards that it is shown."""

    def __init__(self, queries: list[list[tuple[int, int]]], figures: Figures, k: int):
        self.figures, self.weight, self.k = figures, figures.weights(), k
        #: rarest first
        self.queries = [sorted(q, key=lambda x: (figures.df[x[0]], x[0])) for q in queries]
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none.astype(bool)) for _ in queries]
        self.opened = 0

    def show(self, shard: dict) -> None:
        codes, df = shard["code"], shard["df"]
        if len(codes) == 0:
            return
        doc, tf, sizes = shard["doc"], shard["tf"].astype(np.int64), shard["sizes"]
        m = 25 + (75 * sizes * self.figures.texts) // max(self.figures.terms, 1)
        bounds = np.concatenate([[0], np.cumsum(df)])
        impact = np.repeat(self.weight[codes], df) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        most = np.maximum.reduceat(impact, bounds[:-1])
        place = np.full(len(self.weight), -1, np.int64)
        place[codes] = np.arange(len(codes))
        for q, wanted in enumerate(self.queries):
            found = [(place[c], times) for c, times in wanted if place[c] >= 0]
            if found:
                self._one(q, found, bounds, doc, impact, most, shard)

    def _one(self, q: int, found: list, bounds, doc, impact, most, shard: dict) -> None:
        ahead = np.cumsum([int(most[p]) * t for p, t in found][::-1])[::-1].tolist() + [0]
        kth = int(self.best[q][0][-1]) if len(self.best[q][0]) == self.k else 0
        score = np.zeros(len(shard["sizes"]), np.int64)
        open_to, has = True, np.zeros(len(score), bool)
        for i, (p, times) in enumerate(found):
            # a document without an accumulator can still reach at most ``ahead[i]``
            open_to = open_to and ahead[i] >= max(kth, 1)
            own, add = doc[bounds[p] : bounds[p + 1]], impact[bounds[p] : bounds[p + 1]] * times
            if open_to:
                score[own] += add
                has[own] = True
                partial = score[has]
                if len(partial) >= self.k:
                    kth = max(kth, int(np.partition(partial, len(partial) - self.k)[len(partial) - self.k]))
            elif has.any():
                alive = has[own]
                score[own[alive]] += add[alive]
            else:
                return
        self.opened += int(has.sum())
        at = np.flatnonzero(has & (score > 0))
        before, ids, missing = self.best[q]
        score = np.concatenate([before, score[at]])
        ids = np.concatenate([ids, shard["doc_id"][at]])
        missing = np.concatenate([missing, shard["missing"][at]])
        order = _best(score, ids, missing, self.k)
        self.best[q] = score[order], ids[order], missing[order]


def _searched(queries: list[list[tuple[int, int]]], figures: Figures, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries, figures, k)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "code", "df", "doc", "tf")}
                ids = batch.column("doc_id")[i].values
                shard["missing"] = ids.is_null().to_numpy(zero_copy_only=False)
                shard["doc_id"] = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
                search.show(shard)
        task = TaskContext.get().partitionId()
        for q, (score, doc, missing) in enumerate(search.best):
            if len(score):
                n = len(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * n, pa.int32()), pa.array([task] * n, pa.int32()), pa.array(doc, pa.int64(), mask=missing), pa.array(score, pa.int64())],
                    names=["query", "task", "doc_id", "score"],
                )

    return run


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    """Queries with how often each names its terms, in blocks of bounded size, by ascending id."""
    block: list[tuple[object, dict[bytes, int]]] = []
    size, current, counts = 0, None, None
    ordered = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).orderBy("item_id")
    for row in ordered.toLocalIterator():
        if counts is None or row.item_id != current:
            if counts:
                block.append((current, counts))
                size += len(counts)
            if size >= BLOCK:
                yield block
                block, size = [], 0
            current, counts = row.item_id, {}
        for term in terms(*flat(pa.array([row.text], pa.string())))[1].to_pylist():
            counts[term] = counts.get(term, 0) + 1
    if counts:
        block.append((current, counts))
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple[object, dict[bytes, int]]], k: int) -> DataFrame:
    vocabulary = sorted({t for _, counts in block for t in counts})
    number = {t: i for i, t in enumerate(vocabulary)}
    index = written(docs.mapInArrow(_indexed(vocabulary), INDEX), "postings")
    total = index.agg(F.sum("texts"), F.sum("terms")).first()
    counted = index.select(F.explode(F.arrays_zip("code", "df")).alias("x")).groupBy("x.code").agg(F.sum("x.df").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for row in counted.collect():  # one row a term of the block
        df[row.code] = row.df
    figures = Figures(total[0] or 0, total[1] or 0, df)
    queries = [[(number[t], n) for t, n in counts.items()] for _, counts in block]
    return index.mapInArrow(_searched(queries, figures, k), HITS)


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs`` (``doc_id, text``)
    for each item, equal scores by ascending id, one without an id last; all whose score is
    above 0 if they are fewer.

    Queries go in blocks of bounded size, and each block reads all documents. A null text
    has no terms; an item without terms, an empty table of items or of documents gives no
    rows. Rows of ``items`` with the same id are one item with the terms of all; a null id is
    an id. Repeated rows of ``docs`` are documents of their own and each gets a rank. Texts of
    any length are taken whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kind = items.schema[item_id].dataType
    found = None
    for block in _blocks(items, item_id, text):
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query int, item_id {kind.simpleString()}")
        hits = _search_block(source, block, k)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        part = Window.partitionBy("query", F.pmod("task", F.lit(PARTS))).orderBy(*order)
        some = hits.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= k).drop("place")
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
        best = best.filter(F.col("rank") <= k).join(names, "query").select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return found
