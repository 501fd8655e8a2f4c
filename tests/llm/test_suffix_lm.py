import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stewardry.llm import suffix_lm
from stewardry.llm.frames import flat

FOLD = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD)), None]


def normal(text):
    return b" ".join(w.encode() for w in tokens(text)[:-1]).replace(b"\0", b"\1") + b"\0"


def base_scores(learned, docs):
    counts = Counter(t for text in learned for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for i, text in docs:
        own = tokens(text)
        out[i] = (
            len(own), sum(counts[t] > 0 for t in own),
            sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in own), total,
        )
    return out


def learns(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


@pytest.mark.parametrize("common", [suffix_lm.COMMON, 50])
def test_base_score_and_tree(corpus, common):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    want = base_scores([t for i, t in rows if learns(i)], rows)
    model = suffix_lm.learn(corpus, common=common)
    out = {r.doc_id: r for r in suffix_lm.score(corpus, model).collect()}
    assert len(out) == len(rows)
    for i, (n, known, base, total) in want.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(i), n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    a = model.automaton
    spread = 10.0 ** a.logp.astype(float)
    unseen = 256 - int((a.symbol < a.move.shape[1] - 1).sum())
    assert np.allclose(spread[:, :-1].sum(1) + spread[:, -1] * unseen, 1, atol=1e-5)


def test_stream_is_the_normal_text():
    texts = ["A b\n\nC", "", None, "  ", "é\tX ", "one"]
    body, bounds = suffix_lm.stream(*flat(pa.array(texts, pa.string())))
    assert [body[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [normal(t) for t in texts]


def test_automaton_scores_by_the_longest_suffix():
    """Against a walk that looks up the longest kept context of every byte."""
    rng = np.random.default_rng(3)
    text = bytes(rng.choice(list(b"abc "), 3000).tolist())
    rows = {}
    for size in range(0, 4):
        for i in range(3, len(text)):
            key = (size, int.from_bytes(text[i - size : i], "big"))
            rows.setdefault(key, Counter())[text[i]] += 1
    kept = {k: c for k, c in rows.items() if k[0] < 2 or (k[0] == 2 and k[1] % 3) or (k[0] == 3 and (k[1] & 0xFFFF) % 3 and k[1] % 2)}
    kept[0, 0][0] = 5
    a = suffix_lm.build([(n, c, b, k) for (n, c), row in kept.items() for b, k in row.items()])
    used = sorted({b for row in kept.values() for b in row} | {0, 32})

    def distribution(context):
        p = {b: 1 / 256 for b in range(256)}
        for size in range(0, len(context) + 1):
            row = kept.get((size, int.from_bytes(context[len(context) - size :], "big")))
            if row is not None:
                total, kinds = sum(row.values()), len(row)
                p = {b: (row.get(b, 0) + kinds * p[b]) / (total + kinds) for b in range(256)}
        return p

    docs = ["abc abca cab", "c" * 700 + " zz", "", "a b c " * 200]
    body, bounds = suffix_lm.stream(*flat(pa.array(docs)))
    want = []
    for a0, b0 in zip(bounds[:-1], bounds[1:], strict=True):
        whole = bytes(suffix_lm.DEPTH) + body[a0:b0].tobytes()
        want.append(sum(math.log10(distribution(whole[max(0, i - 3) : i])[whole[i]]) for i in range(suffix_lm.DEPTH, len(whole))))
    assert suffix_lm.score_texts(a, body, bounds) == pytest.approx(want, rel=1e-4)
    assert used == np.flatnonzero(a.symbol < a.move.shape[1] - 1).tolist()


def test_odd_rows(odd, nothing, corpus):
    out = suffix_lm.score(odd, suffix_lm.learn(odd)).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = base_scores([t for i, t in rows if learns(i)], rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], want[r.doc_id][3])
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9) and r.score < 0
    model = suffix_lm.learn(nothing)
    assert suffix_lm.score(nothing, model).count() == 0
    assert all(r.n_known == 0 and r.score < 0 for r in suffix_lm.score(odd, model).collect())


def test_beats_words_on_held_out_text(spark, sf_dir):
    from stewardry.llm.frames import table

    docs = table(spark, "/root/testdata/sf0.1", "documents")
    out = [r for r in suffix_lm.score(docs, suffix_lm.learn(docs)).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_every_context_that_passes_is_kept(spark, sf_dir):
    """More than 32,768 contexts pass here; each text scores as by all of them."""
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"[:34]
    words = [a + b + c + letters[rng.integers(34)] for a in letters for b in letters for c in letters]
    texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)] * 10
    docs = [(i, t) for i, t in enumerate(texts)]
    learned = [t for i, t in docs if learns(i)]
    rows = {}
    for t in learned:
        whole = bytes(suffix_lm.DEPTH) + normal(t)
        for i in range(suffix_lm.DEPTH, len(whole)):
            for size in range(suffix_lm.DEPTH + 1):
                rows.setdefault(whole[i - size : i], Counter())[whole[i]] += 1
    kept, passed = {b""}, 0
    for c, row in rows.items():
        total, above = sum(row.values()), rows[c[1:]] if c else None
        if c and total >= 8:
            up = sum(above.values())
            gain = sum(n * math.log(n * up / (total * above[b])) for b, n in row.items())
            assert abs(gain - suffix_lm.GAIN) > 1e-6
            if gain >= suffix_lm.GAIN:
                passed += 1
                kept |= {c[i:] for i in range(len(c))}
    assert passed > 32_768
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = suffix_lm.learn(df)
    assert sum(len(level.contexts) for level in model.automaton.levels) == len(kept)
    out = {r.doc_id: r.score for r in suffix_lm.score(df, model).collect()}

    def probability(c, b):
        while c not in kept:
            c = c[1:]
        row = rows[c]
        return (row[b] + len(row) * (probability(c[1:], b) if c else 1 / 256)) / (sum(row.values()) + len(row))

    for i, t in docs[:20]:
        whole = bytes(suffix_lm.DEPTH) + normal(t)
        want = sum(math.log10(probability(whole[j - suffix_lm.DEPTH : j], whole[j])) for j in range(suffix_lm.DEPTH, len(whole)))
        assert out[i] == pytest.approx(want, rel=1e-4)


def test_shards_score_like_the_whole(corpus, monkeypatch):
    """Also when a worker may keep one shard only."""
    model = suffix_lm.learn(corpus)
    texts = pa.array([r.text for r in corpus.select("text").limit(50).collect()], pa.string())
    body, bounds = suffix_lm.stream(*flat(texts))
    whole = suffix_lm.score_texts(model.automaton, body, bounds)
    for room in (suffix_lm.UNPACKED, 1):
        monkeypatch.setattr(suffix_lm, "UNPACKED", room)
        shards = suffix_lm.Shards(model.shards)
        assert np.allclose(suffix_lm.score_texts(shards, body, bounds), whole, rtol=1e-6)
        assert len(shards.held) == 1 or room > 1
