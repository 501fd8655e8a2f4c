import math
import re

import numpy as np
import pytest

from stewardry.llm import lexical
from stewardry.llm.frames import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, k=10):
    """Every document against every item, term by term."""
    spelled = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in docs]
    n_texts, n_terms = sum(bool(t) for _, t in spelled), sum(len(t) for _, t in spelled)
    df = {}
    for _, t in spelled:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    weight = {x: math.floor(1000 * math.log((2 * n_texts + 2) / (2 * c + 1))) for x, c in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, []).extend(TERM.findall((t or "").translate(FOLD)))
    out = []
    for item, query in wanted.items():
        scored = []
        for doc, t in spelled:
            m = 25 + (75 * len(t) * n_texts) // max(n_terms, 1)
            s = sum(weight[x] * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in query if x in t)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        scored.sort()
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, query string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, task int")
    return sorted([tuple(r) for r in lexical.search(d.repartition(3), q, k).collect()], key=repr)


def test_equals_brute_force(spark, sf_dir):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{int(x)}" for x in rng.zipf(1.3, 400) % 60] + ["Été", "É", "A1", "日本"]
    text = lambda n: "".join(w + str(rng.choice([" ", "-", ", ", "\n", "_"])) for w in rng.choice(vocabulary, n))
    docs = [(i, text(int(rng.integers(0, 40)))) for i in range(300)]
    items = [(i, text(int(rng.integers(1, 8)))) for i in range(25)]
    for k in (1, 3, 10):
        assert found(spark, docs, items, k) == brute(docs, items, k)


def test_odd_rows(spark, sf_dir):
    docs = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None), (3, ""), (4, "-- !"), (5, "ONE " * 50_000), (6, "x" * 200_000 + " two")]
    items = [(7, "one"), (7, "two two"), (8, None), (9, "absent"), (None, "One"), (10, "one ONE")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 2) == brute(docs, items, 2)
    assert found(spark, [], items) == [] == found(spark, docs, [])


def test_blocks_of_queries(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    docs = [(i, f"a{i % 5} b{i % 7} c") for i in range(60)]
    items = [(i, f"a{i} b{i} c c") for i in range(9)]
    assert found(spark, docs, items) == brute(docs, items)


def test_frequent_terms_open_no_accumulators():
    """Once rare terms fill the list, documents with only the frequent term are not touched."""
    n = 1000
    doc = np.concatenate([np.arange(5), np.arange(n)]).astype(np.int32)
    shard = {
        "sizes": np.full(n, 10), "code": np.array([0, 1]), "df": np.array([5, n]), "doc": doc, "tf": np.ones(5 + n, np.int32),
        "doc_id": np.arange(n), "missing": np.zeros(n, bool),
    }
    search = lexical.Search([[(1, 1), (0, 1)]], lexical.Figures(n, 10 * n, np.array([5, n])), 3)
    search.show(shard)
    assert search.opened == 5 and search.best[0][1].tolist() == [0, 1, 2]


@pytest.mark.parametrize("part", ["", "AB cd", "é-É", "\x7fa\x80b", "1_2", "🙂x"])
def test_terms(part):
    import pyarrow as pa

    from stewardry.llm.frames import flat

    text, spelled = lexical.terms(*flat(pa.array([part, part])))
    want = TERM.findall(part.translate(FOLD))
    assert [t.decode() for t in spelled.to_pylist()] == want * 2
    assert text.tolist() == [0] * len(want) + [1] * len(want)


def test_given_tables(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").limit(5)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted([tuple(r) for r in lexical.search(docs, items).collect()], key=repr) == want
