"""Dashboard: counters and recent lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RECENT_APPLICATIONS, RECENT_LOGS
from ..operators.lookup import page

COUNTED = ["pending_admin", "pending_dept", "approved", "rejected", "published"]


def dashboard_stats(
    applications: DataFrame, golden: DataFrame, classifications: DataFrame
) -> DataFrame:
    """All counters in one row: one conditional count per table, then their sum."""
    names = ["total_applications", *COUNTED, "total_golden_records", "total_classifications"]
    parts = [
        applications.agg(
            F.count("*").alias("total_applications"),
            *[F.count_if(F.col("status") == s).alias(s) for s in COUNTED],
        ),
        golden.agg(F.count("*").alias("total_golden_records")),
        classifications.agg(F.count_if(F.col("is_active")).alias("total_classifications")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.sum(n).alias(n) for n in names]).withColumn(
        "pending", F.col("pending_admin") + F.col("pending_dept")
    )


def recent_applications(applications: DataFrame) -> DataFrame:
    return page(applications, "created_at", limit=RECENT_APPLICATIONS)


def recent_logs(logs: DataFrame) -> DataFrame:
    return page(logs, "executed_at", limit=RECENT_LOGS)
