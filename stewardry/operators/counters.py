"""Running counters kept as a table: how many numbers a key has issued and the highest of them.

A batch reads the counters of its own keys, numbers its rows after them, and leaves the next
version of the table. With :class:`~stewardry.sources.manifest.Manifest` the numbers and the
counters become visible together, so two batches never hand out the same number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import pad_number
from ..session import materialize
from ..sources.manifest import Manifest, Snapshot
from .audit import as_audit_rows, step_id, with_app_no
from .numbering import number_within

COUNTERS = "stem string, issued long, highest long"


class Numbered(NamedTuple):
    rows: DataFrame  # the batch with ``n``
    counters: DataFrame  # next version of the whole table


def counters_of(values: DataFrame, column: str, pattern: str) -> DataFrame:
    """The counters of numbers handed out as text so far; ``pattern`` has the key and the number."""
    stem = F.regexp_extract(column, pattern, 1).alias("stem")
    number = F.try_to_number(F.regexp_extract(column, pattern, 2), F.lit("9" * 18)).cast("bigint").alias("number")
    read = values.select(stem, number).filter("stem <> ''")
    return read.groupBy("stem").agg(F.count("*").alias("issued"), F.max("number").alias("highest"))


def own_counters(counters: DataFrame, rows: DataFrame) -> DataFrame:
    """The counters of the keys that ``rows`` names: its keys travel, not the table."""
    return counters.join(rows.select("stem").distinct(), "stem", "left_semi")


def number_after(rows: DataFrame, counters: DataFrame, order: list[str], by: str = "highest") -> Numbered:
    """Numbers ``rows`` per ``stem`` after the counters' ``highest`` (or ``issued``) value."""
    numbered = number_within(rows, ["stem"], order, "_nth")
    used = own_counters(counters, rows).select("stem", F.col(by).alias("_used"))
    placed = materialize(
        numbered.join(used, "stem", "left").withColumn("n", F.coalesce("_used", F.lit(0)) + F.col("_nth")).drop("_used", "_nth")
    )
    added = placed.filter("stem is not null").groupBy("stem").agg(F.count("*").alias("issued"), F.max("n").alias("highest"))
    total = counters.unionByName(added).groupBy("stem").agg(F.sum("issued").alias("issued"), F.max("highest").alias("highest"))
    return Numbered(placed, total)


def number_applications(new: DataFrame, counters: DataFrame, by: str = "highest") -> Numbered:
    """``app_no`` for new applications by ``created_at, id`` after the counters of their years;
    without a creation time there is none."""
    stem = F.concat(F.lit(C.APP_NO_PREFIX + "-"), F.year("created_at").cast("string"), F.lit("-"))
    done = number_after(new.drop("app_no").withColumn("stem", stem), counters, ["created_at", "id"], by)
    number = F.concat("stem", pad_number(F.col("n"), C.APP_NO_WIDTH))
    return Numbered(done.rows.withColumn("app_no", number).drop("stem", "n"), done.counters)


def number_steps(events: DataFrame, applications: DataFrame, counters: DataFrame) -> Numbered:
    """Audit rows of raw events with the next step ids of their applications, by time."""
    rows = with_app_no(events, applications).withColumn("stem", F.col("app_no"))
    done = number_after(rows, counters, ["executed_at", "id"], "issued")
    return Numbered(as_audit_rows(done.rows.withColumn("step_id", step_id(F.col("stem"), F.col("n")))), done.counters)


def create_applications(manifest: Manifest, new: DataFrame) -> Snapshot:
    """Adds ``new`` to the manifest's applications with numbers that no other batch has.

    Optimistic: the batch is numbered after the newest counters; if another batch commits
    first, its numbers were never visible and it is numbered anew. Starts from the numbers
    there are if the manifest has no counters yet.
    """

    def job(now: Snapshot) -> dict[str, DataFrame]:
        known = now.table("applications") if "applications" in now else None
        if "counters" in now:
            counters = now.table("counters")
        elif known is not None:
            counters = counters_of(known, "app_no", "^(.+-)([0-9]+)$")
        else:
            counters = new.sparkSession.createDataFrame([], COUNTERS)
        done = number_applications(new, counters)
        rows = done.rows if known is None else known.unionByName(done.rows, allowMissingColumns=True)
        return {"applications": rows, "counters": done.counters}

    return manifest.transact(job)
