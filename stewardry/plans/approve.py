"""Approval decisions in batches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.audit import batch_audit, with_app_no
from ..operators.lifecycle import (
    authorised, place_actions, refused_actions, replay, taken_actions,
)
from ..session import materialize

DECISION_COLUMNS = ["approved_by", "approved_at", "approved", "comment"]


class Decided(NamedTuple):
    applications: DataFrame  # next version of the whole table
    audit: DataFrame  # new audit rows
    refused: DataFrame  # decisions that changed nothing, with the reason


def decision_action(stage: Column, approved: Column) -> Column:
    """``admin_approve``, ``dept_reject`` and so on; null without a decision."""
    return F.concat(stage, F.when(approved, "_approve").when(~approved, "_reject"))


def approve_batch(
    applications: DataFrame,
    decisions: DataFrame,
    logs: DataFrame,
    principals: DataFrame,
) -> Decided:
    """Apply decisions in time order, each against the status it meets.

    ``decisions`` has ``decision_id, application_id, stage ('admin' | 'dept'), approved,
    comment, acted_by, acted_by_name, at``; ``principals`` (``user_id, role``) says who may
    decide at which stage. Of many decisions on one application only those
    that take effect (one per stage at most) are joined back, so a hot application costs
    its replay and nothing else.
    """
    actions = decisions.select(
        F.col("application_id").alias("app_id"),
        F.col("decision_id").cast("string").alias("event_id"),
        "at",
        decision_action(F.col("stage"), F.col("approved")).alias("action"),
        "acted_by",
    )
    initial = applications.select(F.col("id").alias("app_id"), "status")
    placed = place_actions(authorised(actions, principals), initial, counted=actions)
    states = materialize(replay(placed))
    effective = materialize(
        taken_actions(states)
        .select("event_id", "place")
        .join(
            decisions.filter(F.col("approved").isNotNull()).withColumn("event_id", F.col("decision_id").cast("string")),
            "event_id",
        )
    )
    patch = states.select(F.col("app_id").alias("id"), F.col("status").alias("_status"))
    for stage in ("admin", "dept"):
        chosen = effective.filter(F.col("stage") == stage).select(
            F.col("application_id").alias("id"),
            F.struct(
                F.col("acted_by").alias("approved_by"),
                F.col("at").alias("approved_at"),
                "approved",
                "comment",
            ).alias(f"_{stage}"),
        )
        patch = patch.join(chosen, "id", "left")
    joined = applications.join(patch, "id", "left")
    touched = F.col("_admin").isNotNull() | F.col("_dept").isNotNull()
    columns = []
    for c in applications.columns:
        stage, _, field = c.partition("_")
        if c == "status":
            columns.append(F.coalesce("_status", "status").alias(c))
        elif c == "updated_at":
            last = F.greatest("_admin.approved_at", "_dept.approved_at")
            columns.append(F.when(touched, last).otherwise(F.col(c)).alias(c))
        elif stage in ("admin", "dept") and field in DECISION_COLUMNS:
            taken = F.col(f"_{stage}")
            columns.append(F.when(taken.isNotNull(), taken[field]).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    steps = effective.select(
        "application_id",
        "place",
        F.concat(F.col("stage"), F.lit("_approve")).alias("step_name"),
        F.col("acted_by").alias("executed_by"),
        F.col("acted_by_name").alias("executed_by_name"),
        F.col("at").alias("executed_at"),
        F.when(F.col("approved"), "success").otherwise("failed").alias("status"),
        F.to_json(F.struct("approved", "comment")).alias("details"),
    )
    return Decided(
        joined.select(columns),
        batch_audit(with_app_no(steps, applications), logs),
        refused_actions(placed, states),
    )
