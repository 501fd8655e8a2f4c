import hashlib
from collections import defaultdict

from stewardry.llm import content_sort


def expected(docs):
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        groups[text.translate({ord(c): None for c in " \t\n\x0b\x0c\r"})].append((-len(text), r.doc_id is None, r.doc_id or 0, r.doc_id))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), i == 0, sha) for i, m in enumerate(members)]
    return sorted(out, key=repr)


def got(docs):
    return sorted((tuple(r) for r in content_sort.exact_groups(docs).collect()), key=repr)


def test_against_grouping_in_memory(corpus, odd, nothing):
    assert got(corpus) == expected(corpus)
    assert got(odd) == expected(odd)
    assert got(nothing) == []


def test_hot_text_over_many_ranges(spark, corpus):
    hot = spark.range(3000).selectExpr("id + 10000 AS doc_id", "IF(id % 2 = 0, 'same text', 'same  text') AS text")
    both = corpus.select("doc_id", "text").unionByName(hot).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(both) == expected(both)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_stage_keeps_rows_and_columns(odd, nothing):
    kept = content_sort.without_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    # 5 is the longest of the empty ones, and of the rows repeated under 12 one stays
    assert ids == sorted((r[0] for r in expected(odd) if r[3]), key=repr) and ids.count(12) == 1
    assert content_sort.without_copies(nothing).count() == 0


def test_many_open_runs_are_joined(spark, odd, monkeypatch):
    want = sorted(map(str, content_sort.exact_groups(odd).collect()))
    monkeypatch.setattr(content_sort, "OPEN_RUNS", 0)
    assert sorted(map(str, content_sort.exact_groups(odd).collect())) == want
