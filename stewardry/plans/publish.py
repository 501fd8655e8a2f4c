"""Publishing approved applications as golden records, and taking in what receivers answer.

Publishing makes the records and the feeds. What became of a feed is known only from the
receivers: their answers are a table, and :func:`apply_results` turns it into flags, audit
rows and the external log. A failed answer leaves the record published all the same.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import batch_audit
from ..operators.hierarchy import paths
from ..operators.quality import run_quality_tests
from ..schemas import DEFAULTS, GOLDEN_RECORDS
from ..session import materialize
from ..sources.feeds import FQN_PREFIX, catalog_feed, external_log, publish_feed
from ..sources.tables import conform
from .submit import system_step

#: fixed values: the two receivers as named in the external log
BTP, CATALOG = "btp", "openmetadata"


class Published(NamedTuple):
    golden: DataFrame  # new golden records, not yet sent
    applications: DataFrame  # the published applications with their new status
    audit: DataFrame  # new audit rows
    publish_feed: DataFrame
    catalog_feed: DataFrame
    refused: DataFrame  # approved applications that cannot become a record, with the reason
    refused_audit: DataFrame  # a failed step for each of them


class Answered(NamedTuple):
    golden: DataFrame  # next version of the given records
    audit: DataFrame  # new audit rows
    external_log: DataFrame  # every answer, also of records that are not known


def publish_batch(
    applications: DataFrame,
    golden: DataFrame,
    classifications: DataFrame,
    logs: DataFrame,
    as_of: datetime,
    fqn_prefix: str = FQN_PREFIX,
    actor: tuple[str, str] | None = None,
) -> Published:
    """Turn approved applications into golden records, feeds and audit rows.

    ``actor`` (id, name) is who asked for it; the audit rows of refused applications name
    them, else the system.

    Refused are applications without a code (``no_code``), with a record already
    (``recorded``), whose code a record or a lower id of the batch has (``code_taken``),
    and whose class lies in a cycle (``no_path``). So running a batch again adds nothing.
    """
    at = F.lit(as_of).cast("timestamp")
    approved = applications.filter(F.col("status") == "approved")
    owners = approved.groupBy("material_code").agg(F.min("id").alias("_owner"))
    recorded = golden.select(F.col("application_id").alias("id"), F.lit(True).alias("_recorded")).distinct()
    codes = golden.select("material_code", F.lit(True).alias("_taken")).distinct()
    climbed = paths(classifications).select(
        F.col("id").alias("classification_id"), F.col("path").alias("classification_path"), "complete"
    )
    known = (
        approved.join(recorded, "id", "left").join(codes, "material_code", "left")
        .join(owners, "material_code", "left").join(climbed, "classification_id", "left")
    )
    reason = (
        F.when(F.col("_recorded"), "recorded")
        .when(F.coalesce("material_code", F.lit("")) == "", "no_code")
        .when(F.col("_taken") | (F.col("id") != F.col("_owner")), "code_taken")
        .when(~F.col("complete"), "no_path")
    )
    judged = materialize(known.withColumn("reason", reason))
    records = judged.filter("reason is null").select(
        F.concat(F.lit("gr-"), "id").alias("id"),
        F.col("id").alias("application_id"), "app_no", "material_code", "material_name", "material_desc",
        "classification_id", "classification_path", "attribute_values", "material_type",
        "created_by", at.alias("created_at"), at.alias("updated_at"),
    )
    new_golden = conform(records, GOLDEN_RECORDS, DEFAULTS["golden_records"])
    done = applications.join(records.select(F.col("application_id").alias("id")), "id", "left_semi")
    made = system_step(1, "create_gr", F.lit("success"), F.to_json(F.struct("material_code")))
    steps = records.select(
        "application_id", "app_no", F.col("id").alias("golden_record_id"), F.inline(F.array(made))
    )
    refused = judged.filter("reason is not null")
    failed = system_step(1, "publish", F.lit("failed"), F.lit(None).cast("string"))
    asked = refused.select(
        F.col("id").alias("application_id"), "app_no", F.col("reason").alias("error_message"), F.inline(F.array(failed))
    )
    if actor:
        asked = asked.withColumns({"executed_by": F.lit(actor[0]), "executed_by_name": F.lit(actor[1])})
    stamped = done.withColumn("status", F.lit("published"))
    if "updated_at" in done.columns:
        stamped = stamped.withColumn("updated_at", at)
    return Published(
        new_golden,
        stamped,
        batch_audit(steps.withColumn("executed_at", at), logs),
        publish_feed(new_golden),
        catalog_feed(new_golden, fqn_prefix),
        refused.select("id", "app_no", "material_code", "reason"),
        batch_audit(asked.withColumn("executed_at", at), logs),
    )


def apply_results(
    golden: DataFrame,
    applications: DataFrame,
    results: DataFrame,
    logs: DataFrame,
) -> Answered:
    """Records, audit rows and external log after the receivers' answers.

    ``results`` has ``result_id, golden_record_id, system ('btp' | 'openmetadata'), success,
    reference, response, error_message, at``: the sync id or the entity's name as
    reference. Of several answers of one receiver the latest counts. A record without an
    answer of a receiver keeps its flags; only a success sets them. Quality tests are
    logged with the catalog's answer.
    """
    answer = F.struct("at", F.col("result_id").alias("no"), "success", "reference", "response", "error_message")
    known = golden.select(F.col("id").alias("golden_record_id"))
    latest = (
        results.join(known, "golden_record_id", "left_semi").groupBy("golden_record_id")
        .agg(*[F.max(F.when(F.col("system") == name, answer)).alias(f"_{name}") for name in (BTP, CATALOG)])
        .withColumnRenamed("golden_record_id", "id")
    )
    joined = golden.join(latest, "id", "left")
    btp, catalog = F.col(f"_{BTP}"), F.col(f"_{CATALOG}")
    sent, synced = F.coalesce(btp.success, F.lit(False)), F.coalesce(catalog.success, F.lit(False))
    new = {
        "btp_published": F.when(sent, F.lit(True)),
        "btp_published_at": F.when(sent, btp["at"]),
        "btp_sync_id": F.when(sent, btp.reference),
        "om_synced": F.when(synced, F.lit(True)),
        "om_synced_at": F.when(synced, catalog["at"]),
        "om_entity_fqn": F.when(synced, catalog.reference),
        "updated_at": F.when(sent | synced, F.greatest(btp["at"], catalog["at"])),
    }
    columns = [
        F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in golden.columns
    ]
    heard = run_quality_tests(joined.filter(btp.isNotNull() | catalog.isNotNull()))
    outcome = lambda s: F.when(s, "success").otherwise("failed")
    details = lambda a, name: F.to_json(F.struct(a.success.alias("success"), a.reference.alias(name), a.response.alias("response")))
    steps = F.array(
        F.struct(btp["at"].alias("at"), btp.error_message.alias("error"),
                 system_step(1, "publish_btp", outcome(sent), details(btp, "sync_id")).alias("s")),
        F.struct(catalog["at"].alias("at"), catalog.error_message.alias("error"),
                 system_step(2, "sync_om", outcome(synced), details(catalog, "entity_fqn")).alias("s")),
        F.struct(
            catalog["at"].alias("at"), F.lit(None).cast("string").alias("error"),
            system_step(3, "om_test", outcome(F.col("all_passed")),
                        F.to_json(F.struct("all_passed", F.col("quality_results").alias("results")))).alias("s"),
        ),
    )
    answered = F.filter(steps, lambda s: s["at"].isNotNull())
    rows = heard.select("application_id", F.col("id").alias("golden_record_id"), F.posexplode(answered).alias("nth", "step"))
    rows = rows.select(
        "application_id", "golden_record_id", "step.s.*", F.col("step.at").alias("executed_at"),
        F.col("step.error").alias("error_message"), (F.col("nth") + 1).alias("_nth"),
    ).drop("place").withColumnRenamed("_nth", "place")
    numbers = applications.select(F.col("id").alias("application_id"), "app_no")
    audit = batch_audit(rows.join(numbers, "application_id", "left"), logs)
    log = results.select(
        F.concat(F.lit("ext-"), "result_id").alias("id"), F.col("system").alias("system_name"),
        F.when(F.col("system") == BTP, "publish").otherwise("sync").alias("operation"),
        F.lit("material").alias("entity_type"), F.col("golden_record_id").alias("entity_id"),
        F.col("response").alias("response_payload"), outcome(F.col("success")).alias("status"),
        "error_message", F.col("at").alias("executed_at"),
    )
    return Answered(joined.select(columns), audit, external_log(log))
