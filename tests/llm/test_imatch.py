import hashlib

import numpy as np
import pyarrow as pa
import pytest

from stewardry.llm import imatch
from stewardry.llm.frames import flat, table
from stewardry.llm.imatch import Counts


def edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, follow = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text)
        out.append((doc, n, hashlib.sha256((text[: n - n // 4] + follow[: n // 4]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edited_texts_and_likeness(corpus, ranges):
    lex = imatch.lexicon(corpus)
    out = sorted(imatch.edited_likeness(corpus, lex, ranges).collect())
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in out] == edits([(r.doc_id, r.text) for r in corpus.collect()])
    prints = {}
    for r in out:
        prints[r.doc_id] = r.fingerprint
    order = [r.doc_id for r in out]
    for i, r in enumerate(out):
        follow = prints[order[(i + 1) % len(order)]]
        own, edited, nxt = (np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32)[None] for x in (r.fingerprint, r.edited_fingerprint, follow))
        assert r.near_edited == pytest.approx(float(imatch.likeness(own, edited)[0]))
        assert r.near_next == pytest.approx(float(imatch.likeness(own, nxt)[0]))
    texts = {r.doc_id: r.text for r in corpus.collect()}
    by_text = {}
    for doc, text in texts.items():
        assert by_text.setdefault(text, prints[doc]) == prints[doc]


def test_edited_is_nearer_than_the_next(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = imatch.edited_likeness(docs, imatch.lexicon(docs)).collect()
    assert np.mean([r.near_edited for r in out]) > 0.35
    assert np.mean([r.near_next for r in out]) < 0.01
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_lexicon_is_the_band(spark, sf_dir, odd):
    docs = spark.createDataFrame([(i, f"all w{i % 4} v{i // 2} solo{i}") for i in range(40)], "doc_id long, text string")
    terms = lambda *w: np.sort(imatch.words.hashed(*flat(pa.array([" ".join(w)])))[1])
    assert (imatch.lexicon(docs, 0.2, 0.5) == terms(*(f"w{i}" for i in range(4)))).all()
    assert (imatch.lexicon(docs, 0.01, 0.1) == terms(*(f"v{i}" for i in range(20)))).all()
    assert len(imatch.lexicon(docs.limit(0))) == 0


def test_odd_rows(odd, nothing):
    lex = imatch.lexicon(odd)
    out = imatch.edited_likeness(odd, lex, 4).collect()
    assert len(out) == odd.count()
    unique = odd.filter("doc_id is not null and doc_id <> 12")
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in imatch.edited_likeness(unique, lex, 4).collect())
    assert got == edits([(r.doc_id, r.text) for r in unique.collect()])
    assert imatch.edited_likeness(nothing, lex).count() == 0
    alone = odd.filter("doc_id = 9")
    assert [(r.near_edited, r.near_next) for r in imatch.edited_likeness(alone, lex).collect()] != []


def test_counts_merge():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 500, 10_000, dtype=np.uint64)
    counts = Counts()
    for part in np.array_split(values, 7):
        counts.add(part)
        counts.merge()
    found, times = counts.total()
    want = np.unique(values, return_counts=True)
    assert (found == want[0]).all() and (times == want[1]).all()
