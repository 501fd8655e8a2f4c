"""Audit log: recording, step ids, traces and latest steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import UNKNOWN_APP_NO
from ..functions.labels import status_label, step_label
from ..functions.rows import once
from ..functions.text import iso_time
from ..schemas import AUDIT_LOGS
from ..sources.tables import conform
from .numbering import number_within

STEP_ID = "^(.+)-S([0-9]+)$"


def logged_steps(logs: DataFrame) -> DataFrame:
    """``app_no, logged``: steps each application has so far, read off the step ids."""
    return (
        once(logs, app_no=F.regexp_extract("step_id", STEP_ID, 1))
        .filter(F.col("app_no") != "")
        .groupBy("app_no")
        .agg(F.count("*").alias("logged"))
    )


def with_app_no(events: DataFrame, applications: DataFrame) -> DataFrame:
    """Add ``app_no``; events without a known application share one placeholder."""
    known = applications.select(F.col("id").alias("application_id"), "app_no")
    return events.join(known, "application_id", "left").withColumn(
        "app_no", F.coalesce("app_no", F.lit(UNKNOWN_APP_NO))
    )


def step_id(app_no: Column, number: Column) -> Column:
    return F.concat(app_no, F.lit("-S"), number.cast("string"))


def record_events(events: DataFrame, applications: DataFrame, logs: DataFrame) -> DataFrame:
    """Raw events as audit rows: labels, application number, next step ids by time.

    ``events`` has ``id, application_id, step_name, executed_at, status`` and any further
    audit columns. Events without application all share one key, so numbering is done by
    ranges (see :mod:`numbering`).
    """
    numbered = number_within(with_app_no(events, applications), ["app_no"], ["executed_at", "id"])
    placed = numbered.join(logged_steps(logs), "app_no", "left").withColumn(
        "step_id", step_id(F.col("app_no"), F.coalesce("logged", F.lit(0)) + F.col("n"))
    )
    return as_audit_rows(placed)


def batch_audit(steps: DataFrame, logs: DataFrame) -> DataFrame:
    """Audit rows of a batch job whose steps have a known place within their application.

    ``steps`` has ``application_id, app_no, place, step_name, executed_at, status, details``
    and executor columns; a place is small and fixed by the job, so nothing is numbered.
    """
    number = F.coalesce("logged", F.lit(0)) + F.col("place")
    rows = (
        steps.join(logged_steps(logs), "app_no", "left")
        .withColumn("step_id", step_id(F.col("app_no"), number))
        .withColumn("id", F.concat(F.lit("log-"), "step_id"))
    )
    return as_audit_rows(rows)


def request_audit(requests: DataFrame, step_name: str, applications: DataFrame, logs: DataFrame) -> DataFrame:
    """Audit rows of users' own actions, such as ``create_draft`` or ``save_draft``.

    ``requests`` has ``id, application_id, executed_by, executed_by_name, executed_at`` and
    ``details``; any number per application, numbered by time after the logged steps.
    """
    events = requests.withColumns({"step_name": F.lit(step_name), "status": F.lit("success")})
    return record_events(events, applications, logs)


def as_audit_rows(events: DataFrame) -> DataFrame:
    """Add labels and conform to the audit table."""
    labelled = events.withColumn("step_label", step_label(F.col("step_name"))).withColumn(
        "status_label", status_label(F.col("status"))
    )
    return conform(labelled, AUDIT_LOGS)


def latest_steps(logs: DataFrame) -> DataFrame:
    """The newest row per application and step; only one row per group is ever held."""
    newest = F.max_by(
        F.struct("id", "executed_at", "status", "details"), F.struct("executed_at", "id")
    )
    return (
        logs.filter(F.col("application_id").isNotNull())
        .groupBy("application_id", "step_name")
        .agg(newest.alias("last"))
        .select("application_id", "step_name", "last.*")
    )


def trace_summary(applications: DataFrame, logs: DataFrame) -> DataFrame:
    """One row per application: how many steps it has and which was the last."""
    last = F.max_by(F.struct("step_label", "status", "executed_at"), F.struct("executed_at", "id"))
    per_app = (
        logs.filter(F.col("application_id").isNotNull())
        .groupBy(F.col("application_id").alias("id"))
        .agg(F.count("*").alias("steps"), last.alias("last"))
    )
    return applications.join(per_app, "id", "left").select(
        F.col("id").alias("application_id"),
        "app_no",
        "material_name",
        "material_code",
        "status",
        F.coalesce("steps", F.lit(0)).alias("step_count"),
        F.col("last.step_label").alias("last_step"),
        F.col("last.status").alias("last_status"),
        iso_time(F.col("last.executed_at")).alias("last_executed_at"),
    )


def application_trace(logs: DataFrame, application_id: str | None = None) -> DataFrame:
    """Steps in time order with ISO times, of one application or of all."""
    if application_id is not None:
        logs = logs.filter(F.col("application_id") == application_id)
    return logs.orderBy("application_id", "executed_at", "id").select(
        "application_id", "step_id", "step_name", "step_label", "executed_by",
        "executed_by_name", iso_time(F.col("executed_at")).alias("executed_at"), "status",
        "status_label", "details", "error_message",
    )
