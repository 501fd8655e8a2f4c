"""Who may act on which draft."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import APPLICANT_ROLES


class Judged(NamedTuple):
    accepted: DataFrame  # requests with the application's number
    refused: DataFrame  # requests with the reason


def judge_requests(requests: DataFrame, applications: DataFrame, principals: DataFrame) -> Judged:
    """Requests to change drafts, told apart by status, role and owner.

    ``requests`` has ``application_id, acted_by`` and any further columns. Applicants may act
    on their own applications, administrators on all. Reasons, in this order: ``unknown``
    application, ``role`` (also another's application), ``not_draft``.
    """
    known = applications.select(
        F.col("id").alias("application_id"), "app_no", F.col("status").alias("_status"),
        F.col("created_by").alias("_owner"),
    )
    people = principals.select(F.col("user_id").alias("acted_by"), F.col("role").alias("_role"))
    own = (F.col("_role") != "applicant") | (F.col("_owner") == F.col("acted_by"))
    may = F.coalesce(F.col("_role").isin(APPLICANT_ROLES) & own, F.lit(False))
    reason = (
        F.when(F.col("_status").isNull(), "unknown")
        .when(~may, "role")
        .when(F.col("_status") != "draft", "not_draft")
    )
    judged = (
        requests.join(known, "application_id", "left").join(people, "acted_by", "left")
        .withColumn("reason", reason)
    )
    return Judged(
        judged.filter("reason is null").select(*requests.columns, "app_no"),
        judged.filter("reason is not null").select(*requests.columns, "reason"),
    )
