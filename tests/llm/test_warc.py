import random

import pytest
from pyspark.sql import functions as F

from stewardry.llm import warc


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://WWW.Example.COM:80/a/b/?utm_source=x#frag", "example.com/a/b"),
        ("https://example.com", "example.com"),
        ("https://example.com/?b=1&utm_medium=q&a=2", "example.com?b=1&a=2"),
        ("https://example.com/a?utm_source=1&b=2", "example.com/a?b=2"),
        ("https://m.example.com/A/", "m.example.com/A"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, key):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(warc.canonical(F.col("url")).alias("k")).first().k == key


def records(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["response", "revisit"])
        url = rng.choice([f"http://a.com/{rng.randint(0, 4)}", "https://www.a.com/hot/", "http://a.com/hot#x", None])
        headers = {}
        if rng.random() < 0.8:
            headers[rng.choice(["ETag", "etag"])] = rng.choice(['"1"', 'W/"1"', '"2"'])
        if rng.random() < 0.5:
            headers["Last-Modified"] = rng.choice(["x", "y"])
        if rng.random() < 0.7:
            headers["Expires"] = str(i)
        headers["Content-Length"] = str(i)
        at = None if rng.random() < 0.03 else rng.randint(0, 60) * (1000 if rng.random() < 0.2 else 1)
        out.append((i, url, at, kind, headers if rng.random() < 0.97 else None, f"sha{i}" if kind == "response" else None))
    return out


def key_of(url):
    return None if url is None else url.split("#")[0].split("://")[1].removeprefix("www.").rstrip("/")


def expected(rows):
    out = {}
    lower = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for i, url, at, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        headers = lower(headers)
        hits = [r for r in rows if r[3] == "response" and url is not None and key_of(r[1]) == key_of(url) and None not in (at, r[2]) and r[2] < at]
        if not hits:
            out[i] = ("missing", None, None, headers, None)
            continue
        hit = max(hits, key=lambda r: (r[2], r[0]))
        stored = lower(hit[4])
        weak = lambda t: t.removeprefix("W/")
        if "etag" in headers and "etag" in stored:
            same = weak(headers["etag"]) == weak(stored["etag"])
        else:
            same = "last-modified" in headers and headers["last-modified"] == stored.get("last-modified")
        if same:
            merged = stored | {k: v for k, v in headers.items() if k in warc.PERMITTED}
            out[i] = ("resolved", hit[0], hit[2], merged, hit[5])
        else:
            out[i] = ("changed", hit[0], hit[2], headers, None)
    return out


@pytest.mark.parametrize(("seed", "slots"), [(1, 1024), (2, 3), (3, 1)])
def test_against_a_scan(spark, seed, slots):
    rows = records(seed)
    df = spark.createDataFrame(rows, warc.RECORDS).withColumn("slot", F.lit("clash")).withColumn("lo", F.lit(1))
    out = warc.resolve_revisits(df, slots).collect()
    got = {r.record_id: (r.status, r.refers_to, r.refers_at, r.headers, r.payload_sha256) for r in out}
    assert got == expected(rows) and len(out) == len(got)
    assert {s for s, *_ in got.values()} == {"resolved", "changed", "missing"}


def test_empty_and_payload(spark):
    df = spark.createDataFrame(records(4), warc.RECORDS)
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    resolved = warc.resolve_revisits(df)
    bodies = df.filter("kind = 'response'").select("record_id", F.concat(F.lit("body "), "record_id").alias("payload"))
    rows = warc.with_payload(resolved, bodies).collect()
    assert rows and all(r.payload == f"body {r.refers_to}" for r in rows)


def test_a_hot_url_is_spread_over_slots(spark):
    df = spark.range(2000).select(
        F.col("id").alias("record_id"), F.lit("http://hot.example/").alias("url"), F.col("id").alias("at"),
        F.when(F.col("id") % 500 == 0, "response").otherwise("revisit").alias("kind"),
        F.create_map(F.lit("ETag"), F.lit('"1"')).alias("headers"), F.lit(None).cast("string").alias("payload_sha256"),
    )
    out = warc.resolve_revisits(df, 64)
    assert {(r.record_id, r.refers_to) for r in out.collect()} == {(i, i // 500 * 500) for i in range(2000) if i % 500}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan and "CartesianProduct" not in plan


def test_slots_hold_about_as_many_records(spark):
    """One wrong time does not put all else into one slot."""
    times = [*range(20_000), 10**15]
    df = spark.createDataFrame([(t,) for t in times], "at long")
    cuts = sorted({int(c) for c in df.approxQuantile("at", [i / 100 for i in range(1, 100)], 0.001)})
    sizes = [r["count"] for r in df.groupBy(warc._slot(F.col("at"), cuts).alias("slot")).count().collect()]
    assert len(sizes) > 80 and max(sizes) < 800
    for row in df.sample(0.01, seed=1).withColumn("slot", warc._slot(F.col("at"), cuts)).collect():
        assert row.slot == sum(c <= row["at"] for c in cuts)
