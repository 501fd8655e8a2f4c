"""Commits over several tables, numbers under concurrent batches, counters, search index."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stewardry.operators import codes, counters, lookup
from stewardry.operators.search_index import SearchIndex
from stewardry.sources.manifest import Conflict, Manifest

SCHEMA = "id string, created_at timestamp, app_no string"


def apps(spark, first, n, year=2026):
    return spark.createDataFrame([(f"a{i:04d}", datetime(year, 1, 1 + i % 20), None) for i in range(first, first + n)], SCHEMA)


def test_a_version_is_whole_or_not_there(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"))
    assert manifest.newest().version == 0 and "x" not in manifest.newest()
    one = manifest.transact(lambda now: {"x": spark.range(3), "y": spark.range(5)})
    assert one.version == 1

    def dies(now):
        manifest.write("x", spark.range(30))  # the job ends before its second table
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        manifest.transact(dies)
    now = manifest.newest()
    assert (now.version, now.table("x").count(), now.table("y").count()) == (1, 3, 5)
    two = manifest.transact(lambda now: {"y": spark.range(7)})
    assert (two.table("x").count(), two.table("y").count()) == (3, 7)
    assert manifest.at(1).table("y").count() == 5


def test_a_version_is_committed_once(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"))
    start = manifest.newest()
    folders = [manifest.write("x", spark.range(i)) for i in (1, 2)]
    manifest.commit(start, {"x": folders[0]})
    with pytest.raises(Conflict):
        manifest.commit(start, {"x": folders[1]})
    assert manifest.newest().table("x").count() == 1
    assert [p.name for p in (tmp_path / "m" / "_commits").iterdir() if p.name.endswith(".json")] == ["000000000001.json"]


def test_concurrent_batches_share_no_number(spark, tmp_path):
    root = str(tmp_path / "m")
    batches = [apps(spark, 100 * k, 7 + k) for k in range(5)]
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda b: counters.create_applications(Manifest(spark, root), b), batches))
    now = Manifest(spark, root).newest()
    rows = now.table("applications").collect()
    assert now.version == 5 and len(rows) == sum(7 + k for k in range(5))
    assert sorted(r.app_no for r in rows) == [f"SQ-2026-{i:05d}" for i in range(1, len(rows) + 1)]
    assert [(r.stem, r.issued, r.highest) for r in now.table("counters").collect()] == [("SQ-2026-", len(rows), len(rows))]


def test_counters_number_like_the_whole_history(spark):
    old = spark.createDataFrame([("SQ-2025-00007",), ("SQ-2026-00003",), ("SQ-2026-00001",), ("odd",), (None,)], "app_no string")
    new = apps(spark, 0, 5).unionByName(apps(spark, 50, 3, 2025)).unionByName(spark.createDataFrame([("none", None, None)], SCHEMA))
    kept = counters.counters_of(old, "app_no", "^(.+-)([0-9]+)$")
    for by, numbering in (("highest", "max"), ("issued", "count")):
        done = counters.number_applications(new, kept, by)
        want = codes.application_numbers(new, old, numbering)
        assert sorted(map(str, done.rows.select("id", "app_no").collect())) == sorted(map(str, want.select("id", "app_no").collect()))
    again = counters.number_applications(apps(spark, 80, 2), counters.number_applications(new, kept).counters)
    assert sorted(r.app_no for r in again.rows.collect()) == ["SQ-2026-00009", "SQ-2026-00010"]


def test_a_batch_reads_its_own_counters(spark, tmp_path):
    path = str(tmp_path / "counters")
    spark.range(1000).select(F.concat(F.lit("K"), "id").alias("stem"), F.lit(1).cast("long").alias("issued"), F.col("id").alias("highest")).write.parquet(path)
    own = counters.own_counters(spark.read.parquet(path), spark.createDataFrame([("K5",), ("K7",)], "stem string"))
    assert sorted(r.stem for r in own.collect()) == ["K5", "K7"]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Aggregate" not in plan.split("LeftSemi")[0]
    one = spark.read.parquet(path).filter(F.col("stem") == "K5")
    assert "EqualTo(stem,K5)" in one._jdf.queryExecution().executedPlan().toString()


WORDS = ["Anvil", "ring E", "RING e", "95% pure", "a_b", "乙醇工业级", "ab", "", None, "ringing", "xRing", "bring it"]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = [(str(i), WORDS[i % len(WORDS)], WORDS[(i * 7) % len(WORDS)]) for i in range(300)]
    table = spark.createDataFrame(rows, "id string, name string, code string")
    return table, SearchIndex(table, ["name", "code"])


@pytest.mark.parametrize("query", ["ring", "Ring E", "RING", "%", "5% p", "_", "乙醇工", "醇", "ab", "nowhere", "", "ing", "bring it"])
def test_index_equals_scan(indexed, query):
    table, index = indexed
    want = sorted(tuple(r) for r in lookup.search(table, query, ["name", "code"]).collect())
    assert sorted(tuple(r) for r in index.search(query).collect()) == want


def test_frequent_trigrams_fill_chunks(spark, monkeypatch):
    monkeypatch.setattr(SearchIndex, "CHUNK", 10)
    table = spark.createDataFrame([(str(i), "steel plate") for i in range(500)], "id string, name string")
    index = SearchIndex(table, ["name"])
    sizes = [len(r.ids) for r in index.postings.filter("gram = 'ste'").collect()]
    assert sum(sizes) == 500 and len(sizes) > 30 and max(sizes) < 60
    assert index.search("EL PL").count() == 500


def test_a_query_reads_few_folders(indexed):
    _, index = indexed
    plan = index.candidates("anvil")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(gram" in plan


def test_pairs_stay_in_their_task(spark, monkeypatch):
    """Rows and trigrams meet without a shuffle of pairs: what is shuffled is the postings."""
    plans = []
    written = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: (plans.append(self._df), written(self, path, *a, **b))[1])
    words = ["Ünï códe 乙醇", "𝔘𝔫𝔦 code", "aaaaaa", None, "xy", ""]
    table = spark.createDataFrame([(str(i), words[i % 6], f"Code {i}") for i in range(1200)], "id string, name string, code string")
    index = SearchIndex(table, ["name", "code"])
    plan = plans[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Join" not in plan
    held = {(r.row, r.gram) for r in index.postings.select(F.explode("ids").alias("row"), "gram").collect()}
    texts = [(r.id, t.lower()) for r in table.collect() for t in (r.name, r.code) if t]
    assert held == {(i, t[k : k + 3]) for i, t in texts for k in range(len(t) - 2)}
    uses = {r.gram: r.uses for r in index.postings.groupBy("gram").agg(F.sum("uses").alias("uses")).collect()}
    assert uses["cod"] == 1200 and uses["aaa"] == 200
    assert index.search("códe 乙").count() == 200 == index.search("𝔘𝔫𝔦").count() and index.search("aaaa").count() == 200


def test_invalid_bytes_and_long_texts_are_indexed(spark):
    table = spark.sql("SELECT cast(id AS string) AS id, CASE WHEN id % 2 = 0 THEN decode(unhex('C3'), 'ISO-8859-1') ELSE repeat('long text ', 300000) END AS name, cast(unhex('C3616263') AS string) AS code FROM range(6)")
    index = SearchIndex(table, ["name", "code"])
    assert index.search("G TEXT LON").count() == 3 and index.search("abc").count() == 6
