"""Governance overview: catalog, lineage, quality history, traces, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.json_values import attribute_count
from ..functions.rows import unfold
from ..functions.text import blank_to_null, iso_time
from ..operators.audit import trace_summary
from ..operators.hierarchy import paths
from ..sources.feeds import FQN_PREFIX, stored_or_derived_fqn

DETAILS = (
    "passed boolean, errors array<string>, "
    "results array<struct<test_name:string,passed:boolean,message:string>>"
)
VALIDATOR = "validator"


def catalog(
    golden: DataFrame, classifications: DataFrame, fqn_prefix: str = FQN_PREFIX
) -> DataFrame:
    """One row per golden record with path, attribute count, catalog name and flags."""
    climbed = paths(classifications).select(
        F.col("id").alias("classification_id"), F.col("path").alias("_path")
    )
    return golden.join(climbed, "classification_id", "left").select(
        "id",
        "application_id",
        "material_code",
        "material_name",
        "material_type",
        F.coalesce(
            blank_to_null(F.col("classification_path")), "_path", F.lit("")
        ).alias("classification_path"),
        attribute_count(F.col("attribute_values")).alias("attribute_count"),
        "status",
        "version",
        "revision",
        "btp_published",
        iso_time(F.col("btp_published_at")).alias("btp_published_at"),
        "om_synced",
        iso_time(F.col("om_synced_at")).alias("om_synced_at"),
        stored_or_derived_fqn(fqn_prefix).alias("om_entity_fqn"),
        iso_time(F.col("created_at")).alias("created_at"),
    )


def _record_node() -> Column:
    return F.concat(F.lit("gr-"), F.col("id"))


def fixed_nodes(spark) -> DataFrame:
    """The three nodes every graph has."""
    rows = [(*node, None) for node in (C.NODE_SOURCE, C.NODE_PUBLISH, C.NODE_CATALOG)]
    return spark.createDataFrame(rows, "id string, label string, type string, subtitle string")


def with_sources(golden: DataFrame, applications: DataFrame) -> DataFrame:
    """Golden records with the label and subtitle of the application behind them."""
    apps = applications.select(
        F.col("id").alias("application_id"),
        F.struct(F.col("app_no").alias("label"), F.col("material_name").alias("subtitle")).alias(
            "_app"
        ),
    )
    unknown = F.struct(F.col("application_id").alias("label"), F.col("material_name").alias("subtitle"))
    return golden.join(apps, "application_id", "left").withColumn(
        "_source", F.when(has_source(), F.coalesce("_app", unknown))
    )


def has_source() -> Column:
    return blank_to_null(F.col("application_id")).isNotNull()


def _app_node() -> Column:
    return F.concat(F.lit("app-"), F.col("application_id"))


def record_nodes(golden: DataFrame, applications: DataFrame) -> DataFrame:
    """One node per golden record and one per application behind a golden record."""
    source = F.struct(
        _app_node().alias("id"), F.col("_source.label").alias("label"),
        F.lit("application").alias("type"), F.col("_source.subtitle").alias("subtitle"),
    )
    record = F.struct(
        _record_node().alias("id"), F.col("material_code").alias("label"),
        F.lit("golden_record").alias("type"), F.col("material_name").alias("subtitle"),
    )
    nodes = F.array_compact(F.array(F.when(has_source(), source), record))
    return with_sources(golden, applications).select(F.inline_outer(nodes))


def lineage_nodes(golden: DataFrame, applications: DataFrame) -> DataFrame:
    return fixed_nodes(golden.sparkSession).unionByName(record_nodes(golden, applications))


def edge_rows() -> Column:
    """The edges one golden record has, with the labels of both ends."""
    app = (_app_node(), F.col("_source.label"), F.coalesce("_source.subtitle", F.lit("application")))
    record = (_record_node(), F.col("material_code"), F.coalesce("material_name", F.lit("golden_record")))
    fixed = lambda node: (F.lit(node[0]), F.lit(node[1]), F.lit(node[2]))
    synced = F.col("om_synced") | blank_to_null(F.col("om_entity_fqn")).isNotNull()

    def edge(when: Column, start: tuple, end: tuple, text: str) -> Column:
        ends = [
            column.alias(f"{side}{part}")
            for side, node in (("from", start), ("to", end))
            for column, part in zip(node, ("", "_label", "_subtitle"))
        ]
        return F.when(when, F.struct(*ends, F.lit(text).alias("label")))

    return F.array_compact(
        F.array(
            edge(has_source(), app, record, C.EDGE_CREATED),
            edge(F.col("btp_published"), record, fixed(C.NODE_PUBLISH), C.EDGE_PUBLISHED),
            edge(synced, record, fixed(C.NODE_CATALOG), C.EDGE_SYNCED),
        )
    )


def lineage_view(golden: DataFrame, applications: DataFrame) -> DataFrame:
    """Edges with the labels of both ends.

    Both ends of an edge come from one golden record, its application or a fixed node, so
    one join serves all edges. Joining edges to nodes by id would send every edge into an
    external node to one task.
    """
    rows = with_sources(golden, applications).withColumn("_edges", edge_rows())
    return unfold(rows, "_edges", []).select("item.*")


def lineage_edges(golden: DataFrame) -> DataFrame:
    """``from, to, label`` of all edges, from one scan of the golden records."""
    none = F.lit(None).cast("struct<label:string,subtitle:string>")
    rows = golden.withColumn("_source", none).withColumn("_edges", edge_rows())
    return unfold(rows, "_edges", []).select("item.from", "item.to", "item.label")


def latest_results(logs: DataFrame) -> DataFrame:
    """Per application the newest ``validate`` and ``om_test`` rows, in one aggregate."""
    wanted = logs.filter(
        F.col("step_name").isin("validate", "om_test") & F.col("application_id").isNotNull()
    )
    newest = lambda step: F.max_by(
        F.struct("details", "executed_at"),
        F.when(F.col("step_name") == step, F.struct("executed_at", "id")),
    )
    parsed = lambda log: F.when(
        attribute_count(log.details) > 0,
        F.struct(
            F.from_json(log.details, DETAILS).alias("d"), iso_time(log.executed_at).alias("at")
        ),
    )
    grouped = wanted.groupBy("application_id").agg(
        newest("validate").alias("validated"), newest("om_test").alias("tested")
    )
    return grouped.select(
        "application_id",
        parsed(F.col("validated")).alias("validated"),
        parsed(F.col("tested")).alias("tested"),
    )


def quality_history(golden: DataFrame, logs: DataFrame, validator: str = VALIDATOR) -> DataFrame:
    """A row per latest validation and a row per result of the latest quality test."""
    outcome = lambda flag: F.when(F.coalesce(flag, F.lit(False)), "passed").otherwise("failed")

    def row(key: Column, name: Column, passed: Column, message: Column, at: Column, source: str):
        return F.struct(
            key.alias("id"), name.alias("test_name"), outcome(passed).alias("status"),
            message.alias("message"), at.alias("executed_at"), F.lit(source).alias("source"),
        )

    errors = blank_to_null(F.array_join("validated.d.errors", "; "))
    validated = F.when(
        F.col("validated").isNotNull(),
        row(
            F.concat(F.lit("validate-"), "id"), F.lit(C.HISTORY_VALIDATE_NAME),
            F.col("validated.d.passed"), F.coalesce(errors, F.lit(C.HISTORY_VALIDATE_OK)),
            F.col("validated.at"), validator,
        ),
    )
    tested = F.transform(
        F.col("tested.d.results"),
        lambda r, i: row(
            F.concat_ws("-", F.lit("om"), "id", i.cast("string")),
            F.coalesce(r.test_name, F.lit(C.HISTORY_TEST_DEFAULT)), r.passed, r.message,
            F.col("tested.at"), C.HISTORY_TEST_SOURCE,
        ),
    )
    validations = F.array_compact(F.array(validated))
    rows = golden.join(latest_results(logs), "application_id").select(
        "material_code",
        F.when(tested.isNull(), validations)
        .otherwise(F.concat(validations, tested))
        .alias("results"),
    )
    return unfold(rows, "results", ["material_code"]).select(
        "item.id", "material_code", "item.test_name", "item.status", "item.message",
        "item.executed_at", "item.source",
    )


def overview_summary(
    golden: DataFrame, applications: DataFrame, logs: DataFrame
) -> DataFrame:
    """Asset, sync, publish, quality-test and traceability counts in one row."""
    parts = [
        golden.agg(
            F.count("*").alias("metadata_assets"),
            F.count_if(F.col("om_synced")).alias("om_synced"),
            F.count_if(F.col("btp_published")).alias("btp_published"),
        ),
        quality_history(golden, logs).agg(F.count("*").alias("quality_tests")),
        trace_summary(applications, logs).agg(
            F.count_if(F.col("step_count") > 0).alias("traceable_applications")
        ),
    ]
    first, second, third = parts
    rows = first.unionByName(second, allowMissingColumns=True).unionByName(
        third, allowMissingColumns=True
    )
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def overview(
    golden: DataFrame,
    applications: DataFrame,
    classifications: DataFrame,
    logs: DataFrame,
) -> dict[str, DataFrame]:
    """All parts, over the whole tables."""
    return {
        "summary": overview_summary(golden, applications, logs),
        "catalog": catalog(golden, classifications),
        "nodes": lineage_nodes(golden, applications),
        "edges": lineage_edges(golden),
        "quality_tests": quality_history(golden, logs),
        "traces": trace_summary(applications, logs),
    }
