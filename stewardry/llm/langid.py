"""Language identification by nearest centroid.

A text's vector holds the counts of its byte bigrams and trigrams (letters and blanks only, A-Z folded,
hashed to DIMS places), dampened by a logarithm, weighted by inverse document frequency
and scaled to length one. Each language has several centroids, found by clustering its
sample; the nearest by cosine names the language. A text is rejected if it lies farther off
than nearly all texts of that language and of about its length do from centroids that were
found without them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm import words
from stewardry.llm.frames import flat, remainder, slices, unused

DIMS = 1 << 13
#: Bound of the sample that centroids are clustered from, per language and for all of them.
SAMPLE = 256
SAMPLE_ALL = 4096
#: Values of ``lang`` that can be learned: the most frequent ones, two texts of each at least.
LANGUAGES = SAMPLE_ALL // 2
CENTROIDS = 4
#: A text is rejected below this share of the lowest percentile of its language's cosines.
SLACK = 0.9
#: Bytes of the beginnings by which the cosines of short texts are measured.
CUTS = (6, 12, 24, 48, 96, 192, 384, 768, 1536)
#: Lengths are told apart by the logarithm of the number of grams, up to this.
SIZES = 16
#: cosines of a length that say where its lowest percentile is
ENOUGH = 100
#: Clusters of a smaller share of the sample are dissolved.
LEAST = 0.03

LETTER = "_llm_letter"

#: what counts as a letter byte; all else is one blank class
_KEEP = np.zeros(256, np.uint64)
_KEEP[[*range(97, 123)]] = np.arange(97, 123)
_KEEP[[*range(65, 91)]] = np.arange(97, 123)
_KEEP[[*range(128, 256)]] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gram counts, one row of DIMS places for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)
    if len(data) < 2:
        return out
    mapped = _KEEP[data]
    text = np.repeat(np.arange(n), np.diff(offsets))
    for width in (2, 3):
        if len(data) < width:
            break
        code = mapped[: len(mapped) - width + 1].copy()
        solid = mapped[: len(code)] > 0
        for k in range(1, width):
            nxt = mapped[k : k + len(code)]
            code = code << np.uint64(8) | nxt
            solid |= nxt > 0
        code = (words.mix(code + np.uint64(width)) >> np.uint64(8)).astype(np.int64) % DIMS
        first, last = text[: len(code)], text[width - 1 :]
        use = (first == last) & solid
        out += np.bincount(first[use] * DIMS + code[use], minlength=n * DIMS).reshape(n, DIMS)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(size, 1e-12)


def lengths(tf: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(tf.sum(axis=1), 1)).astype(np.int64), SIZES - 1)


@dataclass
class Centroids:
    idf: np.ndarray
    centres: np.ndarray
    names: list[str]
    floors: np.ndarray  # by centre and length

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = x @ self.centres.T
        best = cosines.argmax(axis=1)
        return best, np.clip(cosines[np.arange(len(x)), best], 0.0, 1.0)


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """At most 128 texts and about a quarter of a megabyte at a time."""
    for part in slices(batch, "text", 1 << 18):
        for at in range(0, part.num_rows, 128):
            yield part.slice(at, 128)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMS, np.int64), 0
    for whole in batches:
        for batch in _small(whole):
            seen += (counts(*flat(batch.column("text"))) > 0).sum(axis=0)
            n += batch.num_rows
    yield pa.RecordBatch.from_arrays(
        [pa.array([*range(DIMS), -1], pa.int32()), pa.array([*seen.tolist(), n], pa.int64())], names=["place", "n"]
    )


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _small(whole):
            tf = counts(*flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("head"), pa.array([row.tobytes() for row in tf], pa.binary())],
                names=["lang", "head", "tf"],
            )


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from centres spread out greedily."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        near = np.max(np.stack([x @ c for c in centres]), axis=0)
        centres.append(x[near.argmin()])
    c = np.stack(centres)
    for last in [False] * 9 + [True]:
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        sizes = np.bincount(own, minlength=len(c))
        keep = [i for i in range(len(c)) if sizes[i] >= (max(2, LEAST * len(x)) if last else 1)]
        c = np.stack([x[own == i].mean(axis=0) for i in keep or [int(sizes.argmax())]])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _floors(tf: np.ndarray, heads: list[str], idf: np.ndarray) -> np.ndarray:
    """The least cosine by length, from each half of the texts and of their beginnings against
    centroids of the other half. A length with fewer than ENOUGH takes the next shorter ones' in.
    """
    found: list[list[float]] = [[] for _ in range(SIZES)]
    x = vectors(tf, idf)
    for half in (0, 1):
        out = np.arange(len(x)) % 2 == half
        if not out.any():
            continue
        c = _cluster(x[~out] if (~out).any() else x, CENTROIDS)
        parts = [tf[out]]
        own = [h.encode() for h, o in zip(heads, out.tolist(), strict=True) if o]
        for size in CUTS:
            cut = [h[:size].decode(errors="ignore") for h in own if len(h) > size]
            parts += [counts(*flat(pa.array(cut[at : at + 128], pa.string()))) for at in range(0, len(cut), 128)]
        for part in parts:
            cosines = (vectors(part, idf) @ c.T).max(axis=1)
            for k, cosine in zip(lengths(part).tolist(), cosines.tolist(), strict=True):
                found[k].append(cosine)
    floors = np.zeros(SIZES)
    for k in range(SIZES):
        cosines, shorter = found[k], k
        while len(cosines) < ENOUGH and shorter:
            shorter -= 1
            cosines = cosines + found[shorter]
        if cosines:
            floors[k] = SLACK * float(np.quantile(cosines, 0.01))
    return floors


def learn(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Centroids | None:
    """Centroids from texts with a letter and a language whose id's remainder by 4 is not 2.

    Document frequencies cover all of them. The clusters come from at most ``sample``
    texts of each language and SAMPLE_ALL in all, those of the smallest hashes of id and
    text; a language of repeated rows, which share a hash, gives what it has. Of more than
    ``languages`` values of ``lang`` the most frequent are learned. Null ids, languages and
    texts are read as the filters above say; ties go by text; other columns are ignored. None
    if there is nothing to learn from.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).filter(remainder("doc_id", 4) != 2)
    known = known.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    df = known.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    df = {r.place: r.n for r in df.collect()}  # DIMS + 1 numbers
    n = df.get(-1, 0)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.array([df[i] for i in range(DIMS)]))).astype(np.float32) + np.float32(0.1)
    langs = known.groupBy("lang").agg(F.count("*").alias("n"))
    top = [(r.lang, r.n) for r in langs.orderBy(F.desc("n"), "lang").limit(languages).collect()]
    each = max(2, min(sample, SAMPLE_ALL // len(top)))
    # keep about twice as many by hash, then the first ones exactly
    wanted = [(a, min(1.0, 2 * each / m + 20 / m), min(each, m)) for a, m in top]
    share = F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, share double, least long"))  # ``languages`` rows
    unit = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    passing = known.join(share, "lang").filter(unit <= F.col("share")).groupBy("lang").agg(F.count("*").alias("n"))
    enough = {r.lang for r in passing.join(share, "lang").filter("n >= least").select("lang").collect()}
    # repeated rows pass or fail together: of a language with too few, all are drawn from
    wanted = [(a, s if a in enough else 1.0) for a, s, _ in wanted]
    share = F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, share double"))
    few = known.join(share, "lang").filter(unit <= F.col("share")).drop("share")
    first = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("nth") <= each)
    first = first.select("lang", "text", F.substring("text", 1, max(CUTS) + 1).alias("head"))
    rows = first.mapInArrow(_count_rows, "lang string, head string, tf binary").collect()  # SAMPLE_ALL rows at most
    centres, names, floors = [], [], []
    for lang, _ in sorted(top):
        own = [r for r in rows if r.lang == lang]
        if not own:
            continue
        tf = np.stack([np.frombuffer(r.tf, np.float32) for r in own])
        c = _cluster(vectors(tf, idf), CENTROIDS)
        centres += list(c)
        names += [lang] * len(c)
        floors += [_floors(tf, [r.head for r in own], idf)] * len(c)
    return Centroids(idf, np.stack(centres), names, np.array(floors))


def _identified(model, make, letter: str = LETTER):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array(m.names, object) if m else np.array(["und"], object)
        for whole in batches:
            for batch in _small(whole):
                letters = batch.column(batch.schema.get_field_index(letter)).to_numpy(zero_copy_only=False)
                if m:
                    tf = counts(*flat(batch.column("text")))
                    best, cosine = m.nearest(vectors(tf, m.idf))
                    floor = m.floors[best, lengths(tf)]
                else:
                    best, cosine, floor = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), 1.0
                reject = ~letters | (cosine < floor)
                yield make(batch, np.where(letters, names[best], "und"), np.where(letters, cosine, 0.0), reject)

    return run


def _with_letter(docs: DataFrame, letter: str = LETTER) -> DataFrame:
    return docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row, whole texts.

    ``und`` with score 0 for a null text or one without a letter, and for all if nothing was
    learned; else the language of the nearest centroid and its cosine. Ties go to the
    language first in order. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch, lang, cosine, reject) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(cosine, pa.float64()), pa.array(reject)],
            names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
        )

    source = _with_letter(docs.select(F.col("doc_id").cast("bigint"), (remainder("doc_id", 4) == 2).alias("held_out"), "text"))
    out = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return source.mapInArrow(_identified(shared, make), out)


def without_rejected(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """The rows not rejected, with all their columns, whatever their names.

    A null text and one without a letter are rejected, and all rows if nothing was learned.
    Repeated rows stay or go together; an empty table stays empty.
    """
    letter = unused(LETTER, docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch, lang, cosine, reject) -> pa.RecordBatch:
        return batch.filter(pa.array(~reject)).drop_columns([letter])

    return _with_letter(docs, letter).mapInArrow(_identified(shared, make, letter), docs.schema)
