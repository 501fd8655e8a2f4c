"""Creating and submitting applications in batches."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SYSTEM_USER, SYSTEM_USER_NAME
from ..operators.access import judge_requests
from ..operators.audit import batch_audit
from ..operators.codes import advance_rules, application_numbers, generate_codes
from ..operators.dedup import check_duplicates
from ..operators.validate import validate
from ..session import materialize
from ..sources.tables import conform_table

RESULT_COLUMNS = [
    "status", "material_code", "validation_result", "validation_passed", "dedup_result",
    "is_duplicate", "submitted_at", "updated_at",
]


class Submitted(NamedTuple):
    applications: DataFrame  # every draft of the batch with its outcome
    audit: DataFrame  # new audit rows
    rules: DataFrame  # next version of the code rules
    refused: DataFrame | None  # requests that their actor may not make, with the reason


def create_batch(
    new: DataFrame, existing: DataFrame, at: Column, numbering: str = "max"
) -> DataFrame:
    """New applications as numbered drafts with the table's defaults."""
    stamped = new.withColumn("created_at", at).withColumn("updated_at", at)
    return conform_table(application_numbers(stamped, existing, numbering), "material_applications")


def system_step(place: int, name: str, status: Column, details: Column) -> Column:
    """A step the system executes, as a struct for :func:`batch_audit`."""
    return _step(place, name, status, details, F.lit(SYSTEM_USER), F.lit(SYSTEM_USER_NAME))


def _step(place, name, status, details, user, user_name) -> Column:
    return F.struct(
        F.lit(place).alias("place"),
        F.lit(name).alias("step_name"),
        status.alias("status"),
        details.alias("details"),
        user.cast("string").alias("executed_by"),
        user_name.cast("string").alias("executed_by_name"),
    )


def submit_steps(outcome: DataFrame) -> DataFrame:
    """The steps of each submitted draft: only ``validate`` when it failed, else all four."""
    passed = F.col("validation_passed")
    success = F.lit("success")
    code = F.to_json(F.struct("material_code"))
    steps = F.array(
        system_step(
            1, "validate", F.when(passed, "success").otherwise("failed"),
            F.to_json("validation_result"),
        ),
        system_step(2, "dedup_check", success, F.to_json("dedup_result")),
        system_step(3, "code_generate", success, code),
        _step(4, "submit", success, code, F.col("_by"), F.col("_by_name")),
    )
    taken = F.when(passed, steps).otherwise(F.slice(steps, 1, 1))
    return outcome.select(F.col("id").alias("application_id"), "app_no", F.inline_outer(taken))


def submit_batch(
    applications: DataFrame,
    classifications: DataFrame,
    templates: DataFrame,
    rules: DataFrame,
    golden: DataFrame,
    logs: DataFrame,
    as_of: datetime,
    requests: DataFrame | None = None,
    principals: DataFrame | None = None,
) -> Submitted:
    """Submit drafts: validate, look for duplicates, hand out codes, move on.

    ``requests`` (``application_id, acted_by, acted_by_name``) are the drafts to submit and
    who submits them, checked against ``principals``; of several for one draft the first
    by user counts. Without requests every draft is submitted by its creator. A draft that
    fails validation stays a draft, keeps its other columns and has its result stored.
    Codes are handed out by ``created_at, id``. The outcome is written once, so all
    outputs agree.
    """
    at = F.lit(as_of).cast("timestamp")
    drafts = applications.filter(F.col("status") == "draft")
    refused = None
    if requests is None:
        drafts = drafts.withColumns({"_by": F.col("created_by"), "_by_name": F.col("created_by_name")})
    else:
        judged = judge_requests(requests, applications, principals)
        refused = judged.refused
        who = F.min(F.struct("acted_by", "acted_by_name")).alias("_who")
        first = judged.accepted.groupBy(F.col("application_id").alias("id")).agg(who)
        drafts = drafts.join(first, "id").withColumns(
            {"_by": F.col("_who.acted_by"), "_by_name": F.col("_who.acted_by_name")}
        ).drop("_who")
    checked = materialize(validate(drafts, classifications, templates))
    accepted = checked.filter("validation_passed")
    requests = accepted.select("id", "classification_id", "material_type", "created_at")
    issued = applications.filter(F.col("material_code").isNotNull()).select("material_code")
    coded = generate_codes(
        requests, classifications, rules, golden, issued, as_of.year, ["created_at", "id"]
    )
    dedup = check_duplicates(accepted.select("id", "material_name"), golden)
    kept = [c for c in applications.columns if c not in RESULT_COLUMNS]
    passed = F.col("validation_passed")
    outcome = materialize(
        checked.select(
            *kept, "_by", "_by_name", "validation_result", "validation_passed",
            F.col("material_code").alias("_code"), F.col("dedup_result").alias("_dedup"),
            F.col("is_duplicate").alias("_duplicate"),
        )
        .join(coded.select("id", "material_code", "rule_id", "seq"), "id", "left")
        .join(dedup.select("id", "dedup_result", "is_duplicate"), "id", "left")
        .withColumn("status", F.when(passed, "pending_admin").otherwise("draft"))
        .withColumn("material_code", F.when(passed, F.col("material_code")).otherwise(F.col("_code")))
        .withColumn("dedup_result", F.when(passed, F.col("dedup_result")).otherwise(F.col("_dedup")))
        .withColumn("is_duplicate", F.when(passed, F.coalesce("is_duplicate", F.lit(False))).otherwise(F.col("_duplicate")))
        .drop("_code", "_dedup", "_duplicate")
        .withColumn("submitted_at", F.when(passed, at))
        .withColumn("updated_at", at)
    )
    audit = batch_audit(submit_steps(outcome).withColumn("executed_at", at), logs)
    changed = outcome.select(applications.columns)
    return Submitted(changed, audit, advance_rules(rules, outcome), refused)
