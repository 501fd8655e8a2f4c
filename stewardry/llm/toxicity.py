"""Toxicity: a support vector machine on a gap-weighted subsequence kernel of words.

The kernel of two words sums over the three-letter subsequences that both hold; each
occurrence weighs DECAY to the power of its stretch, at most SPAN letters, so inserted
characters lower a match but do not undo it. Nyström landmarks give the kernel's feature
space, in which a linear SVM is trained. The training rows are words of labelled sentences:
those of clean documents are negatives, and of a toxic document the word that looks worst is
its positive (chosen anew after each fit). A sentence is as bad as its worst word and a
document as its worst sentence, so the learned machine folds into one weight per
subsequence. An insult made of several ordinary words is not caught.

Beyond SAMPLE, fitting is bounded: at most 600 witness words of toxic documents and 2,000
words of clean ones are trained on, and a training word counts with its first 46 letters.
Scoring reads whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm import words
from stewardry.llm.frames import flat, remainder, slices

#: Bound of the sample of labelled documents that the machine is fitted on, per label.
SAMPLE = 1500
#: Longer documents are left out of that sample, which bounds what the driver holds.
SAMPLE_CHARS = 20_000
#: Fewer positives than this teach nothing; every score is then PRIOR.
LEAST = 3
PRIOR = 0.05
THRESHOLD = 0.7
LANDMARKS = 128
DECAY = 0.6
SPAN = 7
WIDTH = 48  # letters of a word that are compared at once; longer words go in overlapping parts
SYMBOLS = 48
ROUNDS = 3
WITNESSES = 3

#: letter classes: a-z, a word's start and end, other bytes spread over the rest
_CLASS = np.empty(256, np.int64)
_CLASS[:] = 29 + np.arange(256) % (SYMBOLS - 29)
_CLASS[[*range(97, 123)]] = np.arange(1, 27)
_CLASS[[*range(65, 91)]] = np.arange(1, 27)
START, END = 27, 28
SOFT = 0.05  # added to a squared norm, so that words of two letters resemble nothing

#: (i, j, k) steps of a subsequence that begins at a letter: distances to the next two
STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters and digits of all words; text number and span there of every unit.

    A unit is a word without its other characters, or a run of single characters set apart
    by blanks, taken as one word.
    """
    text, starts, ends = words.spans(data, offsets)
    lone = ends - starts == 1
    joins = np.zeros(len(text), bool)
    joins[1:] = lone[1:] & lone[:-1] & (text[1:] == text[:-1])
    head = np.flatnonzero(~joins)
    tail = np.append(head[1:], len(text))[: len(head)] - 1
    letter = _LETTER[data]
    upto = np.concatenate([[0], np.cumsum(letter)])
    text, starts, ends = text[head], upto[starts[head]], upto[ends[tail]]
    keep = ends > starts
    return data[letter], text[keep], starts[keep], ends[keep]


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of each unit's letters between the marks in rows of WIDTH, zero beyond, and the unit of each row. Units of more letters take several overlapping rows."""
    step = WIDTH - 1 - SPAN
    sizes = ends - starts
    parts = np.maximum(1, -(-(sizes - SPAN) // step))
    unit = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[unit] + nth * step
    columns = begin[:, None] + np.arange(WIDTH - 1)[None, :]
    last = ends[unit][:, None]
    inside = columns < last
    rows = np.zeros((len(unit), WIDTH), np.int64)
    rows[:, 0] = np.where(nth == 0, START, 0)
    if len(data):
        rows[:, 1:] = np.where(inside, _CLASS[data[np.minimum(columns, len(data) - 1)]], 0)
    rows[:, 1:][columns == last] = END
    return rows, unit


def subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each start and pair of steps: the rows it exists in, its code and its weight."""
    filled = int((rows != 0).any(axis=0).nonzero()[0].max(initial=0)) + 1
    for i in range(filled):
        for j, k in STEPS:
            if i + k >= filled:
                continue
            a, b, c = rows[:, i], rows[:, i + j], rows[:, i + k]
            there = np.flatnonzero((a != 0) & (c != 0))
            yield there, (a[there] * SYMBOLS + b[there]) * SYMBOLS + c[there], DECAY ** (k + 1)


def _norms(rows: np.ndarray) -> np.ndarray:
    total = np.full(len(rows), SOFT)
    for there, _, weight in subsequences(rows):
        total[there] += weight * weight
    return np.sqrt(total)


def features(rows: np.ndarray) -> np.ndarray:
    """Explicit kernel features of a few rows, scaled by length."""
    out = np.zeros((len(rows), SYMBOLS**3), np.float32)
    for there, code, weight in subsequences(rows):
        np.add.at(out, (there, code), weight)
    return out / _norms(rows)[:, None].astype(np.float32)


@dataclass
class Machine:
    """``weights`` per subsequence, and the line from a document's worst word to a score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def word_values(self, rows: np.ndarray) -> np.ndarray:
        """Decision value of each row."""
        order = np.argsort((rows != 0).sum(axis=1), kind="stable")
        out = np.empty(len(rows))
        for part in np.array_split(order, max(1, len(order) // 20_000)):
            block = rows[part]
            total, square = np.zeros(len(part)), np.full(len(part), SOFT)
            for there, code, weight in subsequences(block):
                total[there] += weight * self.weights[code]
                square[there] += weight * weight
            out[part] = total / np.sqrt(square) + self.bias
        return out

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


NOTHING = float("-inf")


def worst_words(machine: Machine, texts: pa.Array, known: words.Known | None = None) -> np.ndarray:
    """The largest decision value among each text's words; -inf without words.

    ``known`` keeps the values of words that this task has seen.
    """
    data, offsets = flat(texts)
    worst = np.full(len(texts), NOTHING)
    data, text, starts, ends = units(data, offsets)
    if len(text) == 0:
        return worst
    h = words.span_hashes(data, starts, ends)
    distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
    known = words.Known(np.float64) if known is None else known
    met, values = known.find(distinct)
    new = np.flatnonzero(~met)
    if len(new):
        for part in np.array_split(new, max(1, len(new) // 20_000)):
            rows, unit = letters(data, starts[first[part]], ends[first[part]])
            found = np.full(len(part), NOTHING)
            np.maximum.at(found, unit, machine.word_values(rows))
            values[part] = found
        if len(known.keys) > 1_000_000:
            known.__init__(np.float64)
            new = np.arange(len(distinct))
        known.add(distinct[new], values[new])
    np.maximum.at(worst, text, values[back])
    return worst


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]


def _kernel_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x1 @ w)
        on = slack > 0
        a, cw = x1[on], c * weight[on]
        gradient = ridge * w - 2 * a.T @ (cw * y[on] * slack[on])
        hessian = np.diag(ridge) + 2 * (a.T * cw) @ a
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(sample: list[tuple[str, int]]) -> Machine:
    """A machine from ``(text, label)`` rows; a flat one if either label is all but absent."""
    docs = [(t or "", y) for t, y in sample]
    positives = sum(y for _, y in docs)
    if positives < LEAST or len(docs) - positives < LEAST:
        return _flat(PRIOR)
    # distinct words of every sentence; numbers of words by their hash
    sentence_doc, sentence_words = [], []
    number: dict[int, int] = {}
    spelled: list[bytes] = []
    for d, (text, _) in enumerate(docs):
        parts = _sentences(text)
        data, offsets = flat(pa.array(parts, pa.string()))
        data, of, starts, ends = units(data, offsets)
        h = words.span_hashes(data, starts, ends).tolist()
        row: dict[int, set[int]] = {}
        body = data.tobytes()
        for s, x, a, b in zip(of.tolist(), h, starts.tolist(), ends.tolist(), strict=True):
            if x not in number:
                number[x] = len(spelled)
                spelled.append(body[a:b])
            row.setdefault(s, set()).add(number[x])
        for group in row.values():
            sentence_doc.append(d)
            sentence_words.append(np.fromiter(group, np.int64))
    label = np.array([y for _, y in docs])
    in_toxic, in_clean = np.zeros(len(spelled)), np.zeros(len(spelled))
    doc_words: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
    by_doc: dict[int, list[np.ndarray]] = {}
    for d, group in zip(sentence_doc, sentence_words, strict=True):
        by_doc.setdefault(d, []).append(group)
    for d, groups in by_doc.items():
        doc_words[d] = np.unique(np.concatenate(groups))
        (in_toxic if label[d] else in_clean)[doc_words[d]] += 1
    # the first choice of a witness: the word that the label goes with most surely
    among_toxic, among_clean = in_toxic / label.sum(), in_clean / (1 - label).sum()
    sure = among_toxic / (among_toxic + 4 * among_clean + 1 / label.sum())
    value = np.where(sure > 0.7, 1 + sure, sure - 2)  # three documents at least
    toxic_docs = [d for d in range(len(docs)) if label[d] and len(doc_words[d])]
    if not toxic_docs:
        return _flat(PRIOR)
    clean = np.flatnonzero(in_clean > 0)
    random = np.random.default_rng(11)
    machine = None
    for _ in range(ROUNDS):
        # a document's worst words, if they look bad; without one it has nothing to teach
        tops = [doc_words[d][np.argsort(-value[doc_words[d]], kind="stable")[:WITNESSES]] for d in toxic_docs]
        witness = np.concatenate(tops)
        witness = witness[value[witness] > 0]
        if len(witness) == 0:
            return _flat(PRIOR)
        good, times = np.unique(witness, return_counts=True)
        often_first = np.argsort(-times, kind="stable")[:600]
        good, times = good[often_first], times[often_first]
        near = clean[np.argsort(-value[clean], kind="stable")[:1000]]  # the clean words that look worst
        often = clean[np.argsort(-in_clean[clean], kind="stable")[:300]]
        some = random.choice(clean, min(700, len(clean)), replace=False)
        bad = np.setdiff1d(np.unique(np.concatenate([near, often, some])), good)
        machine = _fit_words(
            [spelled[i] for i in good], [spelled[i] for i in bad],
            times, in_clean[good],
        )
        everything = pa.array(spelled, pa.binary())
        value = _values(machine, everything)
    worst = np.array([value[w].max() if len(w) else NOTHING for w in doc_words])
    told = (label == 0) | (worst > 0)
    machine.slope, machine.offset = _platt(worst[told], label[told])
    return machine


def _flat(prior: float) -> Machine:
    return Machine(np.zeros(SYMBOLS**3), 0.0, 0.0, float(np.log(prior / (1 - prior))))


def _values(machine: Machine, spelled: pa.Array) -> np.ndarray:
    data, offsets = flat(spelled.cast(pa.large_binary()).view(pa.large_string()))
    out = np.full(len(spelled), NOTHING)
    rows, unit = letters(data, offsets[:-1], offsets[1:])
    np.maximum.at(out, unit, machine.word_values(rows))
    return out


def _inserted(word: bytes, nth: int) -> bytes:
    """The word with one letter doubled or one put in between."""
    at = 1 + nth // 2 % max(1, len(word) - 1)
    return word[:at] + (word[at - 1 : at] if nth % 2 else b"x") + word[at:]


def _fit_words(good: list[bytes], bad: list[bytes], times: np.ndarray, clean_uses: np.ndarray) -> Machine:
    """Nyström landmarks, half of either kind, and the machine in their feature space."""
    worn = [_inserted(w, i) for i, w in enumerate(good) if len(w) <= 16] + [
        _inserted(w, i + 1) for i, w in enumerate(good[:100]) if len(w) <= 16
    ]
    spelled = good + worn + bad
    y = np.concatenate([np.ones(len(good) + len(worn)), -np.ones(len(bad))])
    # a witness of many documents is sure, one that clean documents use as well is doubtful
    weight = np.concatenate([times / (1 + clean_uses), np.full(len(worn), 0.3), np.ones(len(bad))])
    weight = np.minimum(weight, 20)
    weight[y > 0] *= max(0.2, len(bad) / weight[y > 0].sum() / 2)
    body = np.frombuffer(b"".join(w[: WIDTH - 2] for w in spelled), np.uint8)
    ends = np.cumsum([min(len(w), WIDTH - 2) for w in spelled])
    rows, unit = letters(body, np.concatenate([[0], ends[:-1]]), ends)
    rows = rows[np.searchsorted(unit, np.arange(len(spelled)))]
    half, first_bad = LANDMARKS // 2, len(good) + len(worn)
    frequent = np.arange(min(half // 2, len(good)))
    marks = np.unique(np.concatenate(
        [frequent, _spread(rows[: len(good)], half - len(frequent)), first_bad + _spread(rows[first_bad:], half)]
    ))
    base = features(rows[marks])
    k = base @ base.T
    values, vectors = np.linalg.eigh(k.astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.vstack([features(part) @ base.T @ root for part in np.array_split(rows, max(1, len(rows) // 100))])
    w, bias = _kernel_svm(x, y, weight)
    return Machine((base.T @ (root @ w)).astype(np.float64), bias, 1.0, 0.0)


def _spread(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the one least like those already taken."""
    rows = rows[:2000]
    near = np.full(len(rows), -1.0)
    taken: list[int] = []
    nxt = 0
    for _ in range(min(n, len(rows))):
        taken.append(nxt)
        mark = features(rows[nxt : nxt + 1])[0]
        total, square = np.zeros(len(rows)), np.full(len(rows), SOFT)
        for there, code, weight in subsequences(rows):
            total[there] += weight * mark[code]
            square[there] += weight * weight
        near = np.maximum(near, total / np.sqrt(square))
        near[taken] = np.inf
        nxt = int(np.argmin(near))
        if near[nxt] > 0.999:
            break
    return np.array(taken)


def _platt(worst: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic line through the documents' worst values (bounded, rising)."""
    x = np.clip(np.where(np.isfinite(worst), worst, -3.0), -3, 3)
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    # a clean document wrongly called toxic costs three times a miss
    weight = np.where(label == 1, 0.25 / max(n1, 1), 0.75 / max(n0, 1)) * len(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, q = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * x * x).sum() + 1e-2, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, np.array([(g * x).sum() + 1e-2 * a, g.sum() + 1e-2 * b]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled documents of each label whose id's
    remainder by 3 is not 1, those of the smallest hashes of their ids, without documents of
    more than SAMPLE_CHARS characters.

    Labels other than 0 and 1 and null ids are left out. Of contradictory labels the toxic
    one counts, of an id's several texts the first in order; a null text has no words.
    Without labels the machine calls nothing toxic. Other columns are ignored.
    """
    learning = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).filter(
        "id is not null and y in (0, 1)"
    )
    learning = learning.filter(remainder("id", 3) != 1).groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    chosen = None
    for y in (0, 1):
        top = learning.filter(F.col("y") == y).orderBy("h", "id").limit(sample)
        chosen = top if chosen is None else chosen.unionByName(top)
    # at most 2 * sample ids
    rows = (
        docs.select(F.col("doc_id").alias("id"), "text").filter(
            F.char_length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS
        )
        .join(F.broadcast(chosen), "id").groupBy("id", "h", "y").agg(F.min("text").alias("text"))
        .orderBy("h", "id").select("text", "y").collect()
    )
    return fit([(r.text, r.y) for r in rows])


def _scored(machine, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.Known(np.float64)
        for whole in batches:
            for batch in slices(whole, "text"):
                worst = worst_words(machine.value, batch.column("text"), known)
                yield make(batch, machine.value.score(worst))

    return run


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, whole texts.

    A null or wordless text scores lowest. Other columns are ignored; an empty table gives
    no rows. The machine is one bounded array, sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make(batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    source = docs.select(F.col("doc_id").cast("bigint"), (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return source.mapInArrow(_scored(shared, make), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored below ``threshold``, with all their columns, whatever their names.

    A null or wordless text scores lowest and stays. Repeated rows stay or go together; an
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.mapInArrow(_scored(shared, lambda b, s: b.filter(pa.array(s < threshold))), docs.schema)
