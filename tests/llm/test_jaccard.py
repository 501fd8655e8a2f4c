import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stewardry.llm import jaccard, words
from stewardry.llm.components import components

FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def expected(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, **options).collect()}


def test_against_all_pairs(corpus):
    assert got(corpus) == expected([(r.doc_id, r.text) for r in corpus.collect()])


def variants(seed, groups=12, copies=25):
    """Near copies around the threshold, chains of them, and texts that share a common passage."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 5000)}"
    common = [word() for _ in range(40)]
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(int(rng.integers(5, 120)))]
        for _ in range(copies):
            own = list(base)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(0, len(own)))] = word()
            if rng.random() < 0.3:
                own = own[: int(len(own) * 0.9)] + [word()]
            docs.append(" ".join(own))
            if rng.random() < 0.2:
                base = own  # a chain: the ends need not be linked themselves
    docs += [" ".join(common + [word() for _ in range(int(rng.integers(1, 14)))]) for _ in range(60)]
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "tile", "family"), [(1, jaccard.TILE, jaccard.FAMILY), (2, 8, 4)])
def test_near_copies_and_chains(spark, sf_dir, seed, tile, family):
    docs = variants(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(df, tile=tile, family=family) == expected(docs)


def test_every_class_has_one_family_and_its_name_is_in_each_tree(spark):
    # 1 and 2 meet each other most; 3 to 12 meet 2 most; 13 meets none; 14 meets a class without a set
    rows = [(1, 2), (2, 1), *((c, 2) for c in range(3, 13)), (13, 13), (14, 99)]
    homes = jaccard._homes(spark.createDataFrame(rows, "cls long, lead long"), 4)
    found = {r.cls: (r.family, r.tiles, r.leads) for r in homes.collect()}
    assert found[1] == (1, 1, 1) and found[2] == (1, 1, 3) and found[13] == (13, 1, 1) and found[14] == (99, 1, None)
    assert all(found[c] == (2, 3, None) for c in range(3, 13))
    blocks = jaccard._family_blocks(homes.withColumn("shingles", F.lit(b""))).collect()
    trees = {}
    for r in blocks:
        trees.setdefault((r.head, r.band), []).append(r.cls)
    assert sorted(trees[1, 0]) == [1, 2] and trees[13, 0] == [13]
    assert all(2 in trees[2, t] for t in range(3))
    assert sorted(c for t in range(3) for c in trees[2, t] if c != 2) == list(range(3, 13))


def test_odd_rows(odd, nothing):
    result = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()), key=repr)
    sets = {repr(r.doc_id): len(shingles(r.text)) for r in odd.collect()}
    assert len(result) == odd.count()
    assert all(n == sets[repr(i)] for i, n, _ in result)
    own = {repr(i): c for i, _, c in result}
    assert own["1"] == own["2"] == 1 and own["9"] == own["10"] == 9 and own["12"] == 12
    assert own["3"] == 3 and own["4"] == 4 and own["5"] == 5 and own["None"] is None
    assert got(nothing) == {}


def test_stage(odd, nothing):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 10 not in ids and {1, 3, 4, 5, 6, 7, 9, 13, None} <= set(ids)
    assert jaccard.one_of_each(nothing).count() == 0


def test_tree_bound_never_drops_a_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, int(rng.integers(1, 400)), dtype=np.uint64)
        for _ in range(4):
            drop = rng.random(len(base)) > rng.random() * 0.2
            sets.append(np.unique(np.append(base[drop], rng.integers(0, 1 << 62, 3, dtype=np.uint64))))
    tree = jaccard.SignatureTree(sets, np.arange(len(sets)))
    pairs = set(zip(*(x.tolist() for x in tree.pairs()), strict=True))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if jaccard.linked(jaccard.overlap(sets[a], sets[b]), len(sets[a]), len(sets[b])):
            assert (a, b) in pairs


def test_shingle_sets_count_like_words():
    texts = ["a b c d e f", "A b c d e f", "a b", "", "a b c d e a b c d e", "é " * 9]
    body = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    sets = words.shingle_sets(np.frombuffer(body, np.uint8), offsets)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all()


def test_components_of_a_long_chain_and_a_star(spark, sf_dir):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(500).select(F.lit(5000).cast("long").alias("a"), (F.col("id") + 6000).alias("b"))
    roots = {r.node: r.root for r in components(chain.unionByName(star)).collect()}
    assert {roots[i] for i in range(201)} == {0}
    assert {roots[i] for i in range(6000, 6500)} == {5000} and roots[5000] == 5000
