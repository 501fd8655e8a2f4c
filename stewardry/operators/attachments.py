"""Attachment metadata kept as an array on the application row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_CONTENT_TYPE
from ..functions.text import blank_to_null, iso_time, safe_file_name
from ..schemas import ATTACHMENTS


def attachment_rows(uploads: DataFrame, url_prefix: str = "/api/applications") -> DataFrame:
    """Uploads (``application_id, id, file_name, content_type, size, uploaded_by,
    uploaded_by_name, uploaded_at``) as attachment structs keyed by application."""
    name = safe_file_name(F.col("file_name"))
    return uploads.select(
        "application_id",
        "uploaded_at",
        F.struct(
            F.col("id").alias("id"),
            name.alias("original_name"),
            F.concat_ws("-", "id", name).alias("stored_name"),
            F.coalesce(
                blank_to_null(F.col("content_type")), F.lit(DEFAULT_CONTENT_TYPE)
            ).alias("content_type"),
            F.col("size").cast("bigint").alias("size"),
            F.col("uploaded_by").alias("uploaded_by"),
            F.col("uploaded_by_name").alias("uploaded_by_name"),
            iso_time(F.col("uploaded_at")).alias("uploaded_at"),
            F.concat_ws("/", F.lit(url_prefix), "application_id", F.lit("attachments"), "id").alias(
                "download_url"
            ),
        ).alias("attachment"),
    )


def accepted_uploads(applications: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per attachment that goes to a draft: the form to keep at any volume."""
    drafts = applications.filter(F.col("status") == "draft").select(
        F.col("id").alias("application_id")
    )
    return rows.join(drafts, "application_id", "left_semi").select(
        "application_id", "attachment.*"
    ).withColumnRenamed("id", "attachment_id")


def draft_uploads(applications: DataFrame, uploads: DataFrame) -> DataFrame:
    """The uploads that go to a draft, as they come: before rows get their derived texts."""
    drafts = applications.filter(F.col("status") == "draft").select(F.col("id").alias("application_id"))
    return uploads.join(drafts, "application_id", "left_semi")


def append_uploads(
    applications: DataFrame, uploads: DataFrame, at: Column, url_prefix: str = "/api/applications"
) -> DataFrame:
    """:func:`append_attachments` of uploads: they are shuffled once, as they come, and only what
    goes to a draft gets stored names and addresses, next to the draft."""
    return append_attachments(applications, attachment_rows(draft_uploads(applications, uploads), url_prefix), at)


def upload_sizes(applications: DataFrame, accepted: DataFrame) -> DataFrame:
    """Number and total size of each application's attachments, pre-summed before the shuffle."""
    sums = accepted.groupBy("application_id").agg(
        F.count("*").alias("files"), F.sum("size").alias("total_size")
    )
    return (
        applications.select(F.col("id").alias("application_id"))
        .join(sums, "application_id", "left")
        .na.fill(0, ["files", "total_size"])
    )


def append_attachments(applications: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """Append a batch of attachments to drafts' array column, in upload order.

    For exchange in the row layout: one application's files share a row, a form's worth.
    :func:`accepted_uploads` keeps them as rows of their own.
    """
    added = (
        rows.groupBy(F.col("application_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("uploaded_at", "attachment"))).alias("_new"))
        .select("id", F.transform("_new", lambda n: n.attachment).alias("_new"))
    )
    apply = (F.col("status") == "draft") & F.col("_new").isNotNull()
    none = F.array().cast(ATTACHMENTS)
    columns = []
    for c in applications.columns:
        if c == "attachments":
            grown = F.concat(F.coalesce("attachments", none), F.col("_new").cast(ATTACHMENTS))
            columns.append(F.when(apply, grown).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            columns.append(F.when(apply, at).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return applications.join(added, "id", "left").select(columns)


def flat_attachments(applications: DataFrame) -> DataFrame:
    """One row per attachment."""
    return applications.select(
        F.col("id").alias("application_id"), F.inline("attachments")
    ).withColumnRenamed("id", "attachment_id")


def attachment_sizes(applications: DataFrame) -> DataFrame:
    """Number and total size of each application's attachments, computed in the row."""
    sizes = F.transform("attachments", lambda a: a["size"])
    return applications.select(
        F.col("id").alias("application_id"),
        F.coalesce(F.size("attachments"), F.lit(0)).alias("files"),
        F.coalesce(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0)).alias(
            "total_size"
        ),
    )


def find_attachment(applications: DataFrame, application_id: str, attachment_id: str) -> DataFrame:
    """Zero or one attachment row."""
    return flat_attachments(applications.filter(F.col("id") == application_id)).filter(
        F.col("attachment_id") == attachment_id
    )
