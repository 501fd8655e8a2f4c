"""Stream forms of validation, duplicate check, audit ingest and counters.

Each job takes streaming frames from any source and shares its column logic with the
batch operator. Starting, triggering and sinks are the caller's choice; see
:func:`drain` for the bounded run used in checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import build_index, check_duplicates
from ..operators.validate import validate
from ..session import scratch_path, scratch_removed
from .lifecycle import held_rows, merge_held


def validate_stream(
    applications: DataFrame, classifications: DataFrame, templates: DataFrame
) -> DataFrame:
    """Arriving applications with their validation result: a stream-static join, append mode."""
    return validate(applications, classifications, templates)


def dedup_stream(
    applications: DataFrame,
    golden: DataFrame | Callable[[], tuple[object, DataFrame]],
    sink: str,
    checkpoint: str,
    **options,
) -> StreamingQuery:
    """Check every micro-batch against the golden records and write it to ``sink``.

    ``golden``: a snapshot, or a function that returns the newest version's name and
    records; it is asked before each batch, and what differs is filed into the index when the
    name has changed. A batch is written to a folder named by its id, so a repeated batch replaces
    itself.
    """
    newest = golden if callable(golden) else lambda: (None, golden)
    held: dict = {}

    def check(batch: DataFrame, batch_id: int) -> None:
        version, records = newest()
        if "index" not in held:
            held["index"] = build_index(records)
        elif version != held["version"]:
            held["index"].refresh(records)
        held["version"] = version
        with scratch_removed():
            checked = check_duplicates(batch, index=held["index"])
            checked.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        applications.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(**(options or {"availableNow": True}))
        .start()
    )


def distinct_events(
    events: DataFrame, at: str = "executed_at", key: str = "id", delay: str = "7 days"
) -> DataFrame:
    """Audit ingest: repeated event ids are dropped as long as they come within ``delay``.

    Late events up to the bound are kept; state older than it is given up.
    """
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def ingest_events(
    read: Callable[[], DataFrame],
    sink: str,
    checkpoint: str,
    at: str = "executed_at",
    key: str = "id",
    delay: str = "7 days",
) -> list[StreamingQuery]:
    """Audit ingest in which nothing is lost: events within ``delay`` are told apart in the
    state store, later ones against the written log.

    ``read`` opens the source. First :func:`distinct_events` writes what is in time, one folder
    a batch. Then the same source is read once more for rows that were too late for that:
    those more than ``delay`` behind the newest event up to their batch. The few there are
    join the written log, and whose id is not in it is written behind the rest. So state holds
    ids of ``delay`` only, however long the stream. Returns the two queries, both ended.
    """
    spark = read().sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/on_time/batch={batch_id}")

    def write_late(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn(at, F.col(at).cast("timestamp"))
        newest = stamped.agg(F.max(at).alias("newest")).withColumn("nth", F.lit(batch_id))
        newest.write.mode("overwrite").parquet(f"{sink}/newest/part={batch_id}")
        seen = spark.read.parquet(f"{sink}/newest").filter(F.col("nth") <= batch_id)
        bound = seen.agg(F.max("newest")).scalar() - F.expr(f"INTERVAL {delay}")
        late = stamped.filter(F.col(at) < bound)
        known = spark.read.parquet(f"{sink}/on_time").select(key)
        if batch_id:
            older = spark.read.schema(f"{key} string, nth long").parquet(f"{sink}/late")
            known = known.unionByName(older.filter(F.col("nth") < batch_id).select(key))
        fresh = late.join(known, key, "left_anti").dropDuplicates([key])
        fresh.withColumn("nth", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{sink}/late/batch={batch_id}")

    queries = []
    for name, rows, writer in (
        ("state", distinct_events(read(), at, key, delay), write), ("late", read(), write_late)
    ):
        query = (
            rows.writeStream.foreachBatch(writer).option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        queries.append(query)
    return queries


def ingested(spark: SparkSession, sink: str) -> DataFrame:
    """What :func:`ingest_events` has written: every event id once."""
    on_time = spark.read.parquet(f"{sink}/on_time").drop("batch")
    return on_time.unionByName(spark.read.parquet(f"{sink}/late").drop("batch", "nth"))


#: versions held, the change of the batch they came in with it: the status before, if ``known``
VERSIONS = "id string, status string, at timestamp, tie string, nth long"


def status_deltas(changes: DataFrame) -> DataFrame:
    """Versions of applications as :func:`live_counts` takes and compares them.

    ``changes`` has ``id, status, at, tie``: a version of an application as of a time, the
    greater ``tie`` later at the same time. Without a time a version is older than all others.
    """
    tie = F.coalesce(F.col("tie").cast("string"), F.lit(""))
    return changes.select("id", "status", F.col("at").cast("timestamp").alias("at"), tie.alias("tie")).filter("id is not null")


def changed_versions(batch: DataFrame, held: DataFrame) -> DataFrame:
    """``id, status, at, tie, known, before``: the newest version of each application of a
    batch, if it is newer than the one held, with the status held.

    An older version than the one held, or the same again, changes nothing. Of versions of one
    batch with the same time and tie the greatest status counts.
    """
    came = batch.groupBy("id").agg(F.max(F.struct("at", "tie", "status")).alias("new"))
    last = held.groupBy("id").agg(F.max_by(F.struct("at", "tie", "status"), "nth").alias("old"))
    newer = F.struct("new.at", "new.tie") > F.struct("old.at", "old.tie")
    return (
        came.join(last, "id", "left")
        .filter(F.col("old").isNull() | newer)
        .select("id", "new.status", "new.at", "new.tie", F.col("old").isNotNull().alias("known"), F.col("old.status").alias("before"))
    )


def live_counts(versions: DataFrame, sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch's summed changes of the number of applications per status to a
    folder named by its id, so a repeated batch replaces itself; :func:`counts_now` adds them up.

    ``versions`` comes from :func:`status_deltas`. The versions held lie in ``checkpoint`` like
    the lifecycle stream's statuses, so repeated and out-of-order rows are counted right.
    """
    state = f"{checkpoint}/statuses"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = changed_versions(batch, held_rows(spark, state, batch_id, VERSIONS))
        changed.withColumn("nth", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        kinds = (
            spark.read.schema("status string, known boolean, before string").parquet(f"{state}/batch={batch_id}")
            .groupBy("status", "known", "before").agg(F.count("*").alias("n"))
        )
        gone = kinds.filter("known").select(F.col("before").alias("status"), (-F.col("n")).alias("delta"))
        summed = kinds.select("status", F.col("n").alias("delta")).unionByName(gone).groupBy("status").agg(F.sum("delta").alias("delta"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        newest = lambda rows: rows.groupBy("id").agg(
            F.max_by(F.struct("status", "at", "tie"), "nth").alias("last"), F.max("nth").alias("nth")
        ).select("id", "last.*", "nth")
        merge_held(spark, state, batch_id, VERSIONS, newest)

    return (
        versions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def counts_now(spark: SparkSession, sink: str) -> DataFrame:
    """Number of applications per current status: a few rows a batch, added up."""
    total = spark.read.parquet(sink).groupBy("status").agg(F.sum("delta").alias("applications"))
    return total.filter("applications > 0")


def step_counts(logs: DataFrame) -> DataFrame:
    """Live number of audit rows per step and status; partial counts before the shuffle."""
    return logs.groupBy("step_name", "status").agg(F.count("*").alias("steps"))


def read_stream(
    spark: SparkSession, sf_dir: str, name: str, max_bytes: int = 8 << 30
) -> DataFrame:
    """A given table as a file stream; ``max_bytes`` bounds what one micro-batch takes in."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "*.parquet")
        .option("maxBytesPerTrigger", max_bytes)
        .parquet(f"{sf_dir}/{name}.parquet*")
    )


def drain(
    spark: SparkSession, stream: DataFrame, output_mode: str = "append"
) -> DataFrame:
    """Process everything available once and return the result as a table.

    Append and update output goes to Parquet; complete output replaces the result of the
    batch before it.
    """
    folder = scratch_path(spark, "stream")
    sink = f"{folder}/sink"
    writer = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
    )
    if output_mode == "append":
        query = writer.format("parquet").option("path", sink).start()
    else:
        query = writer.foreachBatch(replace_result(sink)).start()
    query.awaitTermination()
    return spark.read.parquet(sink)


def replace_result(sink: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the newest complete result only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    return write


def drain_dedup(spark: SparkSession, applications: DataFrame, golden: DataFrame) -> DataFrame:
    """:func:`dedup_stream` until everything available is checked."""
    folder = scratch_path(spark, "dedup")
    dedup_stream(applications, golden, f"{folder}/sink", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/sink").drop("batch")
