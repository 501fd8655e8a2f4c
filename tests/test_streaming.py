from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stewardry.operators.validate import validate
from stewardry.sources.tables import load_rows
from stewardry.streaming import jobs

EVENT = "id string, step_name string, status string, executed_at timestamp"


def land(spark, path, rows):
    """One more file of (id, minute) events for a stream to find."""
    data = [(i, "submit", "success", datetime(2026, 1, 1) + timedelta(minutes=m)) for i, m in rows]
    spark.createDataFrame(data, EVENT).coalesce(1).write.mode("append").parquet(path)


def test_repeated_events_are_dropped_and_late_ones_kept(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", 0), ("b", 60), ("a", 0)], [("a", 0), ("late", 30), ("c", 600)], [("c", 600), ("too late", 1)]]
    for rows in batches:
        land(spark, source, rows)
        stream = spark.readStream.schema(EVENT).parquet(source)
        (
            jobs.distinct_events(stream, delay="2 hours").writeStream.format("parquet")
            .option("path", sink).option("checkpointLocation", str(tmp_path / "check"))
            .trigger(availableNow=True).start().awaitTermination()
        )
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == ["a", "b", "c", "late"]


def test_no_late_event_is_lost_and_state_is_bounded(spark, tmp_path):
    """Sixty days in order at the default delay; one event that is three weeks late, twice."""
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    day = 24 * 60
    most = 0
    for d in range(0, 60, 6):
        late = [("late", (d - 30) * day)] if d in (36, 54) else []
        land(spark, source, [(f"e{i}", i * day) for i in range(d, d + 6)] + [(f"e{d}", d * day), *late])
        read = lambda: spark.readStream.schema(EVENT).parquet(source)
        state, _ = jobs.ingest_events(read, sink, check)
        most = max(most, state.lastProgress["stateOperators"][0]["numRowsTotal"])
    ids = [r.id for r in jobs.ingested(spark, sink).collect()]
    assert sorted(ids) == sorted([f"e{i}" for i in range(60)] + ["late"])
    assert most <= 20


def test_live_counts_follow_changes(spark, tmp_path):
    """Updates, repeats and versions that come out of order: the counts of the newest statuses."""
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    start = datetime(2026, 1, 1)
    batches = [
        [("a", "draft", 0, "1"), ("b", "draft", 0, "1"), ("c", "draft", 0, "1")],
        [("a", "approved", 5, "1"), ("a", "pending", 3, "1"), ("b", "draft", 0, "1")],  # later first; a repeat
        [("a", "rejected", 4, "9"), ("c", "pending", 0, "2"), ("c", "draft", 0, "1"), (None, "draft", 1, "1")],  # too old; a tie
        [("b", None, 9, "1"), ("d", "draft", None, None)],
    ]
    want = [{"draft": 3}, {"draft": 2, "approved": 1}, {"draft": 1, "approved": 1, "pending": 1}, {"approved": 1, "pending": 1, "draft": 1, None: 1}]
    schema = "id string, status string, at timestamp, tie string"
    for rows, counts in zip(batches, want, strict=True):
        data = [(i, s, None if m is None else start + timedelta(minutes=m), t) for i, s, m, t in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        deltas = jobs.status_deltas(spark.readStream.schema(schema).parquet(source))
        jobs.live_counts(deltas, sink, check).awaitTermination()
        assert {r.status: r.applications for r in jobs.counts_now(spark, sink).collect()} == counts


def test_live_counts_of_many_applications(spark, tmp_path, monkeypatch):
    """No call per application: no state operator runs Python, statuses are merged on the way."""
    from stewardry.streaming import lifecycle

    monkeypatch.setattr(lifecycle, "MERGE", 2)
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id string, status string, at timestamp, tie string"
    for nth in range(5):
        rows = spark.range(3000 * nth, 3000 * nth + 9000).select(
            F.concat(F.lit("a"), F.pmod(F.col("id") * 7, F.lit(11000)).cast("string")).alias("id"),
            F.concat(F.lit("s"), F.pmod(F.col("id") * 13, F.lit(5)).cast("string")).alias("status"),
            F.timestamp_seconds(F.pmod(F.col("id") * 31, F.lit(100000))).alias("at"), F.lpad(F.col("id").cast("string"), 9, "0").alias("tie"),
        )
        rows.coalesce(1).write.mode("append").parquet(source)
        query = jobs.live_counts(jobs.status_deltas(spark.readStream.schema(schema).parquet(source)), sink, check)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == []
    newest = spark.read.parquet(source).groupBy("id").agg(F.max_by("status", F.struct("at", "tie")).alias("status"))
    want = newest.groupBy("status").count()
    assert {r.status: r.applications for r in jobs.counts_now(spark, sink).collect()} == {r.status: r["count"] for r in want.collect()}


def test_stream_validation_equals_batch(spark, tmp_path, classes, templates):
    apps = load_rows(
        spark,
        [{"id": str(i), "material_name": "n" * i, "classification_id": "cls-leaf", "material_type": "raw"} for i in range(9)],
        "material_applications",
    )
    path = str(tmp_path / "apps")
    apps.write.parquet(path)
    stream = spark.readStream.schema(apps.schema).option("maxFilesPerTrigger", 2).parquet(path)
    got = jobs.drain(spark, jobs.validate_stream(stream, classes, templates))
    want = validate(apps, classes, templates)
    pick = lambda df: sorted((r.id, r.validation_passed, r.validation_result.errors) for r in df.collect())
    assert pick(got) == pick(want)


def test_stream_dedup(spark, tmp_path):
    golden = load_rows(spark, [{"id": "g", "material_code": "A", "material_name": "steel plate"}], "golden_records")
    path = str(tmp_path / "apps")
    for i, name in enumerate(["Steel Plate", "other thing"]):
        load_rows(spark, [{"id": str(i), "material_name": name}], "material_applications").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.drain_dedup(spark, stream().select("id", "material_name"), golden)
    assert {r.id: r.is_duplicate for r in out.collect()} == {"0": True, "1": False}
