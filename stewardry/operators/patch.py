"""Partial updates without MERGE: each returns the next version of a table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .access import judge_requests
from .audit import request_audit


def patch_by_id(
    base: DataFrame,
    patch: DataFrame,
    at: Column,
    supplied: str = "supplied",
    key: str = "id",
) -> DataFrame:
    """Set the columns each patch row names in ``supplied``; null is a legal new value.

    Patches for unknown ids change nothing; patched rows get ``updated_at = at``. ``patch``
    holds at most one row per id.
    """
    columns = [c for c in patch.columns if c in base.columns and c != key]
    new = patch.select(key, F.col(supplied).alias("_set"), F.struct(*columns).alias("_new"))
    named = lambda c: F.coalesce(F.array_contains("_set", c), F.lit(False))
    out = []
    for c in base.columns:
        if c in columns:
            out.append(F.when(named(c), F.col("_new")[c]).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_set").isNotNull(), at).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return base.join(new, key, "left").select(out)


def fold_patches(patches: DataFrame, columns: list[str], order: list[str], key: str = "id"):
    """Several patches per id as one: the last non-null value of every column."""
    last = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c)
        for c in columns
    ]
    return patches.groupBy(key).agg(*last)


def save_drafts(
    applications: DataFrame, patches: DataFrame, columns: list[str], at: Column
) -> tuple[DataFrame, DataFrame]:
    """Draft save: non-null patch values, drafts only.

    ``patches`` has one row per id (see :func:`fold_patches`). Returns the next version and
    the patches that were refused, with the reason.
    """
    new = patches.select("id", F.struct(*columns).alias("_new"))
    joined = applications.join(new, "id", "left")
    apply = (F.col("status") == "draft") & F.col("_new").isNotNull()
    out = []
    for c in applications.columns:
        if c in columns:
            out.append(F.when(apply, F.coalesce(F.col("_new")[c], c)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(apply, at).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    refused = (
        patches.join(applications.select("id", "status"), "id", "left")
        .filter(F.col("status").isNull() | (F.col("status") != "draft"))
        .withColumn(
            "reason", F.when(F.col("status").isNull(), "unknown").otherwise("not_draft")
        )
    )
    return joined.select(out), refused


class Saved(NamedTuple):
    applications: DataFrame  # next version
    refused: DataFrame  # saves that change nothing, with the reason
    audit: DataFrame  # one row per accepted save


def save_drafts_as(
    applications: DataFrame,
    saves: DataFrame,
    columns: list[str],
    principals: DataFrame,
    logs: DataFrame,
    order: list[str],
    at: Column,
) -> Saved:
    """Draft saves by their actors: judged by role, owner and status, folded per draft, logged.

    ``saves`` has ``save_id, application_id, acted_by, acted_by_name, at``, the ``columns`` to
    set and those of ``order``, by which later saves of one draft win.
    """
    judged = judge_requests(saves, applications, principals)
    folded = fold_patches(judged.accepted.withColumn("id", F.col("application_id")), columns, order)
    written, _ = save_drafts(applications, folded, columns, at)
    requests = judged.accepted.select(
        F.col("save_id").alias("id"), "application_id", F.col("acted_by").alias("executed_by"),
        F.col("acted_by_name").alias("executed_by_name"), F.col("at").alias("executed_at"),
        F.lit(None).cast("string").alias("details"),
    )
    return Saved(written, judged.refused, request_audit(requests, "save_draft", applications, logs))
