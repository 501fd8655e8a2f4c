"""Lifecycle status per application across micro-batches.

Every micro-batch is replayed like a batch, from the statuses that the batches before have
left: actions that fill more than one run are range-sorted and composed as status maps, so an application
with most of a batch's rows fills many tasks. A batch writes the statuses that it changed; every MERGE
batches they are merged into one table. A repeated batch reads what came before it and
replaces its own folders, so its outcome is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import place_actions, refused_actions, replay, taken_actions
from ..session import materialize, scratch_removed

STATE = "app_id string, status string, nth long"
#: batches whose statuses are kept apart until they are merged
MERGE = 16


def held_rows(spark, state: str, batch_id: int, schema: str = STATE) -> DataFrame:
    """What the batches before ``batch_id`` have left, a row or more an application, the
    greatest ``nth`` newest."""
    merged = batch_id // MERGE * MERGE
    paths = [f"{state}/batch={k}" for k in range(merged, batch_id)]
    if merged:
        paths.append(f"{state}/merged={merged}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_held(spark, state: str, batch_id: int, schema: str, newest: Callable[[DataFrame], DataFrame]) -> None:
    """After every MERGE batches: one table of the ``newest`` row of each application."""
    if (batch_id + 1) % MERGE == 0:
        parts = held_rows(spark, state, batch_id, schema).unionByName(spark.read.schema(schema).parquet(f"{state}/batch={batch_id}"))
        newest(parts).write.mode("overwrite").parquet(f"{state}/merged={batch_id + 1}")


def _newest(held: DataFrame) -> DataFrame:
    return held.groupBy("app_id").agg(F.max_by("status", "nth").alias("status"), F.max("nth").alias("nth"))


def replay_batch(batch: DataFrame, batch_id: int, sink: str, state: str) -> None:
    """Writes a micro-batch's outcome to ``sink`` and the statuses it leaves to ``state``."""
    spark = batch.sparkSession
    with scratch_removed():
        rows = materialize(batch.select("app_id", "event_id", "at", "action", "allowed"))  # the state store runs once
        apps = rows.select("app_id").filter("app_id is not null").distinct()
        held = held_rows(spark, state, batch_id).join(apps, "app_id", "left_semi")
        initial = apps.join(_newest(held), "app_id", "left").select("app_id", F.coalesce("status", F.lit("draft")).alias("status"))
        placed = place_actions(rows, initial)
        states = materialize(replay(placed))
        out = ["app_id", "event_id", "at", "action"]
        met = F.coalesce("status", F.lit("draft"))
        taken = taken_actions(states).select(*out, "source", "target", F.lit(True).alias("taken"))
        refused = refused_actions(placed, states).select(
            *out, met.alias("source"), met.alias("target"), F.lit(False).alias("taken")
        )
        taken.unionByName(refused).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        left = states.select("app_id", "status", F.lit(batch_id).cast("long").alias("nth"))
        left.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        merge_held(spark, state, batch_id, STATE, _newest)


def lifecycle_stream(
    actions: DataFrame, sink: str, checkpoint: str, delay: str = "30 days", **trigger
) -> StreamingQuery:
    """Writes every action of the stream with the status it met and left behind to ``sink``.

    ``actions`` has ``app_id, event_id, at, action, allowed``. An event id that comes again
    within ``delay`` changes nothing; its state is then given up. Actions of one micro-batch
    run in event-time order; one that arrives in a later batch is applied when it arrives.
    The last row of an application holds its current status; rows that were not taken are
    the refused ones. Needs the state store that :func:`stewardry.session.tune` selects.
    """
    once = (
        actions.select(
            "app_id", F.col("event_id").cast("string").alias("event_id"), F.col("at").cast("timestamp").alias("at"),
            "action", "allowed",
        )
        .withWatermark("at", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
    )
    state = f"{checkpoint}/statuses"
    return (
        once.writeStream.foreachBatch(lambda batch, batch_id: replay_batch(batch, batch_id, sink, state))
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
