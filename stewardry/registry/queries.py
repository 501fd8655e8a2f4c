"""Every registered query: governance tables derived from the given ones, one operator each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions import labels
from stewardry.functions.text import iso_time
from stewardry.operators import (
    access, attachments, audit, codes, constraints, counters, dedup, hierarchy, lifecycle, lookup, patch, quality,
    validate,
)
from stewardry.operators.search_index import SearchIndex
from stewardry.plans import approve, backfill, dashboard, overview, publish, submit
from stewardry.session import scratch_path, tune
from stewardry.sources import feeds, tables
from stewardry.sources import testdata as td
from stewardry.sources.manifest import Manifest
from stewardry.streaming import jobs
from stewardry.streaming.lifecycle import lifecycle_stream

AS_OF = datetime(2026, 5, 1, 12, 0, 0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


STORED = {
    "classifications": "material_classifications",
    "templates": "attribute_templates",
    "rules": "code_rules",
    "golden": "golden_records",
    "applications": "material_applications",
    "logs": "audit_logs",
    "principals": "principals",
}


class Data:
    """The governance tables of one data folder, bound on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in td.SQL:
            raise AttributeError(name)
        table = td.bind(self.spark, self.sf_dir, name)
        if name in STORED:
            table = tables.conform_table(table, STORED[name])
        setattr(self, name, table)
        return table

    def given(self, name: str) -> DataFrame:
        return td.given(self.spark, self.sf_dir, name)


def query(build: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    """Register ``build`` under its own name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Data(spark, sf_dir))
    return build


# ---- lists and lookups ------------------------------------------------------------


@query
def classification_list(d):
    return lookup.active_classifications(d.classifications).select(
        "id", "code", "name", "level", labels.level_label(F.col("level")).alias("level_label")
    )


@query
def classification_children(d):
    return lookup.active_classifications(d.classifications, level=2, parent_id="R1").select(
        "id", "code", "name"
    )


@query
def classification_path(d):
    return hierarchy.paths(d.classifications)


@query
def classification_path_deep(d):
    return hierarchy.paths(d.deep_classes)


@query
def classification_tree_flat(d):
    return hierarchy.tree_flat(d.classifications)


@query
def classification_tree_nested(d):
    """The nested form, read back: a row per middle class with its leaves in order."""
    roots = hierarchy.tree_nested(d.classifications).select(
        F.col("code").alias("root_code"), F.posexplode_outer("children").alias("nth", "middle")
    )
    return roots.select(
        "root_code", F.col("nth").cast("bigint").alias("nth"), F.col("middle.code").alias("middle_code"),
        F.array_join("middle.children.code", ",").alias("leaf_codes"),
    )


@query
def parent_codes(d):
    return hierarchy.major_codes(d.classifications).select("id", "code", "major_code")


@query
def class_templates(d):
    return lookup.class_templates(d.templates).select(
        "id", "classification_id", "field_name", "field_label", "field_type", "is_required",
        "sort_order",
    )


@query
def class_rules(d):
    return lookup.rule_of_class(d.rules).select("classification_id", "id", "pattern")


@query
def application_page(d):
    rows = lookup.applications_where(d.applications, status="pending_admin")
    return lookup.page(rows, "created_at", skip=20, limit=100).select(
        "id", "app_no", "status", iso_time(F.col("created_at")).alias("created_at")
    )


@query
def application_page_ranked(d):
    pages = lookup.RankedPages(lookup.applications_where(d.applications, status="pending_admin"), "created_at")
    return pages.page(skip=20, limit=100).select(
        "id", "app_no", "status", iso_time(F.col("created_at")).alias("created_at")
    )


@query
def application_page_after(d):
    rows = lookup.applications_where(d.applications, status="pending_admin")
    return lookup.page_after(rows, "created_at", (datetime(1996, 1, 1), "A5"), 100).select("id", "app_no")


@query
def applications_of_creator(d):
    return lookup.applications_where(d.applications, created_by="C7").select("id", "status")


@query
def application_search(d):
    return lookup.search(d.applications, "Ring E", lookup.APPLICATION_SEARCH).select("id")


@query
def application_search_index(d):
    index = SearchIndex(d.applications, lookup.APPLICATION_SEARCH)
    return index.search("Ring E").select("id")


@query
def golden_search_index(d):
    return SearchIndex(d.golden, lookup.GOLDEN_SEARCH).search("ANVIL").select("id", "material_name")


@query
def golden_search_index_short(d):
    """Two characters: a scan of the stored rows."""
    return SearchIndex(d.golden, lookup.GOLDEN_SEARCH).search("42").select("id")


@query
def trace_search_index(d):
    rows = audit.trace_summary(d.applications, with_labels(d.logs))
    index = SearchIndex(rows, lookup.TRACE_SEARCH, "application_id")
    return index.search("sq-1998").select("application_id", "app_no")


@query
def golden_search(d):
    return lookup.search(d.golden, "ANVIL", lookup.GOLDEN_SEARCH).select("id", "material_name")


@query
def catalog_search(d):
    rows = overview.catalog(d.golden, d.classifications)
    return lookup.search(rows, "STORED.1", lookup.CATALOG_SEARCH).select("id", "om_entity_fqn")


@query
def trace_search(d):
    rows = audit.trace_summary(d.applications, with_labels(d.logs))
    return lookup.search(rows, "sq-1998", lookup.TRACE_SEARCH).select("application_id", "app_no")


@query
def golden_by_code(d):
    return lookup.by_code(d.golden, "M-00000042").select("id", "material_code", "material_name")


@query
def golden_by_codes(d):
    keys = d.given("orders").select(
        F.concat(
            F.lit("M-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
        ).alias("material_code")
    )
    return lookup.by_keys(d.golden, keys, "material_code").select("material_code", "id", "status")


@query
def visible_applications(d):
    return lookup.own_applications(d.applications, d.principals).select("user_id", "id", "status")


@query
def visible_to_applicant(d):
    return lookup.visible_to(d.applications, "C7", "applicant").select("id", "status")


@query
def visible_to_admin(d):
    others = lookup.visible_to(d.applications, "C7", "guest")
    return lookup.visible_to(d.applications, "C1", "data_admin").unionByName(others).select("id", "status")


@query
def visible_counts(d):
    return lookup.visible_counts(d.applications, d.principals)


# ---- constraints and validation ---------------------------------------------------


@query
def constraint_violations(d):
    found = None
    for name, table in [
        ("material_classifications", d.classifications),
        ("attribute_templates", d.templates),
        ("material_applications", d.applications),
        ("code_rules", d.rules),
        ("golden_records", d.golden),
        ("audit_logs", d.logs),
    ]:
        rows = constraints.with_violations(table, constraints.CONSTRAINTS[name]).select(
            F.lit(name).alias("source"), "id", F.explode("violations").alias("violation")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def referential_audit(d):
    return constraints.referential_audit(
        d.classifications, d.templates, d.applications, d.golden, d.rules, d.logs
    )


def golden_batch(d):
    """Before a batch: other class references of some records, and fewer applications."""
    changed = d.golden.filter("version = 1 and right(id, 1) = '7'").select("id")
    marked = d.golden.join(changed.withColumn("_old", F.lit(True)), "id", "left")
    before = marked.withColumn("application_id", F.when(F.col("_old"), F.concat(F.lit("old-"), "id")).otherwise(F.col("application_id")))
    return before.drop("_old"), changed


@query
def referential_delta(d):
    """Findings about golden records' applications, carried over a batch that changes records,
    adds the published applications and takes out the drafts."""
    before, changed = golden_batch(d)
    old_apps = d.applications.filter("status <> 'published'")
    new_apps = d.applications.filter("status <> 'draft'")
    audit_of = lambda golden, apps: constraints.orphans(
        golden.select(F.lit("golden.application").alias("relation"), "id", F.col("application_id").alias("value")), "value", apps
    )
    return constraints.orphans_after(
        audit_of(before, old_apps), "golden.application", d.golden, "application_id", new_apps, changed,
        d.applications.filter("status = 'published'"), d.applications.filter("status = 'draft'"),
    )


@query
def uniqueness_delta(d):
    """Repeated names of records, carried over a batch that renames some of them."""
    changed = d.golden.filter("right(id, 1) = '7'").select("id", F.col("material_name").alias("value"))
    before = d.golden.join(changed.select("id", F.lit(True).alias("_old")), "id", "left").withColumn(
        "material_name", F.when(F.col("_old"), F.lit("old name")).otherwise(F.col("material_name"))
    )
    found = constraints.repeated_keys(before, "material_name").withColumn("key", F.lit("golden.material_name"))
    old = d.spark.createDataFrame([("old name",)], "value string")
    touched = changed.select("value").unionByName(old)
    return constraints.repeats_after(found, "golden.material_name", d.golden, "material_name", touched)


@query
def uniqueness_audit(d):
    repeated = constraints.uniqueness_audit(d.classifications, d.applications, d.golden)
    names = constraints.repeated_keys(d.golden, "material_name").select(
        F.lit("golden.material_name").alias("key"), "value", "copies"
    )
    return repeated.unionByName(names)


@query
def validate_checks(d):
    return validate.check_rows(validate.validate(d.applications, d.classifications, d.templates))


@query
def validate_summary(d):
    checked = validate.validate(d.applications, d.classifications, d.templates)
    return checked.select(
        "id",
        "validation_passed",
        F.size("validation_result.checks").cast("bigint").alias("checks"),
        F.array_join("validation_result.errors", "; ").alias("errors"),
    )


@query
def golden_quality(d):
    return quality.quality_rows(d.golden)


# ---- duplicate detection ----------------------------------------------------------


@query
def dedup_exact(d):
    return dedup.exact_rows(d.applications, d.golden)


@query
def dedup_containment(d):
    rows = dedup.containment_rows(d.applications, d.golden)
    return rows.withColumn("score", F.round("score", 6))


@query
def dedup_result(d):
    checked = dedup.check_duplicates(d.applications.select("id", "material_name"), d.golden)
    return dedup.similar_rows(checked).withColumn("rank", F.col("rank").cast("bigint"))


@query
def dedup_flags(d):
    checked = dedup.check_duplicates(d.applications.select("id", "material_name"), d.golden)
    return checked.select("id", "is_duplicate", F.col("dedup_result.confidence").alias("confidence"))


# ---- numbers and codes ------------------------------------------------------------


@query
def app_numbers(d):
    existing = d.applications.filter(F.col("status").isin("rejected", "published"))
    new = d.applications.filter(~F.col("status").isin("rejected", "published"))
    return codes.application_numbers(
        new.select("id", "created_at"), existing.select("app_no"), "max"
    ).select("id", "app_no")


@query
def app_numbers_by_count(d):
    existing = d.applications.filter(F.col("status").isin("rejected", "published"))
    new = d.applications.filter(~F.col("status").isin("rejected", "published"))
    return codes.application_numbers(
        new.select("id", "created_at"), existing.select("app_no"), "count"
    ).select("id", "app_no")


@query
def step_ids(d):
    rows = audit.record_events(raw_events(d), d.applications, d.old_logs)
    return rows.select("id", "step_id")


@query
def app_numbers_counted(d):
    """Numbers after a counter table instead of all numbers issued so far."""
    existing = d.applications.filter(F.col("status").isin("rejected", "published"))
    new = d.applications.filter(~F.col("status").isin("rejected", "published"))
    kept = counters.counters_of(existing, "app_no", "^(.+-)([0-9]+)$")
    return counters.number_applications(new.select("id", "created_at"), kept).rows.select("id", "app_no")


@query
def step_ids_counted(d):
    kept = counters.counters_of(d.old_logs, "step_id", audit.STEP_ID)
    return counters.number_steps(raw_events(d), d.applications, kept).rows.select("id", "step_id")


@query
def counters_after(d):
    """The counter table that a batch leaves behind."""
    existing = d.applications.filter(F.col("status").isin("rejected", "published"))
    new = d.applications.filter(~F.col("status").isin("rejected", "published"))
    kept = counters.counters_of(existing, "app_no", "^(.+-)([0-9]+)$")
    return counters.number_applications(new.select("id", "created_at"), kept).counters


def created(d):
    """Two batches committed one after the other, both planned from the newest version."""
    manifest = Manifest(d.spark, scratch_path(d.spark, "manifest"))
    drafts = d.applications.filter("status = 'draft'").select("id", "created_at")
    others = d.applications.filter("status <> 'draft'").select("id", "created_at")
    counters.create_applications(manifest, drafts)
    return counters.create_applications(manifest, others)


@query
def create_batches(d):
    return created(d).table("applications").select("id", "app_no")


@query
def create_counters(d):
    return created(d).table("counters")


@query
def audit_records(d):
    rows = audit.record_events(raw_events(d), d.applications, d.old_logs)
    return rows.select("id", "step_id", "step_name", "step_label", "status", "status_label")


def raw_events(d):
    return d.logs.drop("step_id", "step_label", "status_label")


@query
def rule_codes(d):
    return coded(d).filter(F.col("rule_id").isNotNull())


@query
def default_codes(d):
    return coded(d).filter(F.col("rule_id").isNull())


@query
def next_rules(d):
    rules = codes.advance_rules(d.rules, coded(d))
    return rules.select("id", "current_seq")


def coded(d):
    requests = d.applications.filter(F.col("material_type").isNotNull()).select(
        "id", "classification_id", "material_type", "created_at",
        # every known rule may be named, inactive ones as well; unknown names fall to the default
        F.when(F.col("status") == "rejected", F.concat(F.lit("rule-a-"), "classification_id")).alias(
            "code_rule_id"
        ),
    )
    issued = d.applications.filter(F.col("material_code").isNotNull())
    return codes.generate_codes(
        requests, d.classifications, d.rules, d.golden, issued, AS_OF.year, ["created_at", "id"]
    ).select("id", "material_code", "rule_id", "seq")


# ---- audit ------------------------------------------------------------------------


def with_labels(logs):
    return logs.withColumn("step_label", labels.step_label(F.col("step_name"))).withColumn(
        "status_label", labels.status_label(F.col("status"))
    )


@query
def label_audit(d):
    return d.applications.select(
        "id", "status", labels.application_status_label(F.col("status")).alias("status_label")
    )


@query
def trace_summary(d):
    return audit.trace_summary(d.applications, with_labels(d.logs))


@query
def audit_trace(d):
    return audit.application_trace(with_labels(d.logs)).drop("details")


@query
def latest_step(d):
    return audit.latest_steps(d.logs).select(
        "application_id", "step_name", "id", "status", iso_time(F.col("executed_at")).alias("at")
    )


# ---- lifecycle --------------------------------------------------------------------


@query
def lifecycle_state(d):
    placed = lifecycle.place_actions(lifecycle.authorised(d.actions, d.principals))
    states = lifecycle.replay(placed)
    return states.select("app_id", "status", F.size("taken").cast("bigint").alias("taken"))


@query
def lifecycle_taken(d):
    placed = lifecycle.place_actions(lifecycle.authorised(d.actions, d.principals))
    return lifecycle.taken_actions(lifecycle.replay(placed)).select(
        "app_id", "event_id", "action", "source", "target"
    )


@query
def refused_actions(d):
    placed = lifecycle.place_actions(lifecycle.authorised(d.actions, d.principals))
    states = lifecycle.replay(placed)
    return lifecycle.refused_actions(placed, states).select(
        "app_id", "event_id", "action", "status", "reason"
    )


# ---- dashboard and overview -------------------------------------------------------


@query
def dashboard_stats(d):
    return dashboard.dashboard_stats(d.applications, d.golden, d.classifications)


@query
def recent_applications(d):
    return dashboard.recent_applications(d.applications).select("id", "app_no", "status")


@query
def recent_audit(d):
    return dashboard.recent_logs(d.logs).select("id", "step_name", "status")


@query
def catalog(d):
    return overview.catalog(d.golden, d.classifications)


@query
def lineage_nodes(d):
    return overview.lineage_nodes(d.golden, d.applications)


@query
def lineage_edges(d):
    return overview.lineage_edges(d.golden)


@query
def lineage_view(d):
    return overview.lineage_view(d.golden, d.applications)


@query
def quality_history(d):
    return overview.quality_history(d.golden, d.logs)


@query
def overview_summary(d):
    return overview.overview_summary(d.golden, d.applications, with_labels(d.logs))


# ---- batch jobs -------------------------------------------------------------------


def submitted(d):
    apps = d.applications
    return submit.submit_batch(
        apps, d.classifications, d.templates, d.rules, d.golden, d.old_logs, AS_OF
    )


@query
def submit_batch(d):
    return submitted(d).applications.select(
        "id", "status", "material_code", "validation_passed", "is_duplicate",
        F.col("dedup_result.confidence").alias("confidence"),
        iso_time(F.col("submitted_at")).alias("submitted_at"),
    )


@query
def submit_audit(d):
    return submitted(d).audit.select(
        "step_id", "application_id", "step_name", "step_label", "executed_by", "status"
    )


@query
def submit_rules(d):
    return submitted(d).rules.select("id", "current_seq")


def requested(d):
    return submit.submit_batch(
        d.applications, d.classifications, d.templates, d.rules, d.golden, d.old_logs, AS_OF,
        d.requests, d.principals,
    )


@query
def submit_refused(d):
    return access.judge_requests(d.requests, d.applications, d.principals).refused.select(
        "id", "application_id", "acted_by", "reason"
    )


@query
def submit_by_actor(d):
    steps = requested(d).audit.filter("step_name = 'submit'")
    return steps.select("application_id", "step_id", "executed_by", "executed_by_name")


@query
def create_audit(d):
    new = d.applications.select(
        "id", F.col("id").alias("application_id"), F.col("created_by").alias("executed_by"),
        F.col("created_by_name").alias("executed_by_name"), F.col("created_at").alias("executed_at"),
        F.to_json(F.struct("app_no")).alias("details"),
    )
    return audit.request_audit(new, "create_draft", d.applications, d.old_logs).select(
        "application_id", "step_id", "step_name", "executed_by", "executed_by_name", "details"
    )


@query
def upload_audit(d):
    rows = uploads(d).select(
        F.col("attachment_id").alias("id"), "application_id", F.col("uploaded_by").alias("executed_by"),
        F.col("uploaded_by_name").alias("executed_by_name"),
        F.to_timestamp("uploaded_at").alias("executed_at"),
        F.to_json(F.struct("attachment_id", "original_name", "size")).alias("details"),
    )
    return audit.request_audit(rows, "save_draft", d.applications, d.old_logs).select(
        "application_id", "step_id", "step_name", "executed_by"
    )


def published(d):
    return publish.publish_batch(d.applications, d.golden, d.classifications, d.old_logs, AS_OF)


@query
def publish_batch(d):
    return published(d).golden.select(
        "id", "application_id", "material_code", "classification_path", "status", "version",
        "btp_published", "om_synced",
    )


@query
def publish_applications(d):
    return published(d).applications.select(
        "id", "status", iso_time(F.col("updated_at")).alias("updated_at")
    )


def answered(d):
    done = published(d)
    return publish.apply_results(done.golden, d.applications, d.results, done.audit)


@query
def publish_results(d):
    return answered(d).golden.select(
        "id", "btp_published", "btp_sync_id", iso_time(F.col("btp_published_at")).alias("btp_published_at"),
        "om_synced", "om_entity_fqn", iso_time(F.col("updated_at")).alias("updated_at"),
    )


@query
def publish_result_audit(d):
    return answered(d).audit.select(
        "application_id", "golden_record_id", "step_id", "step_name", "status", "error_message",
        iso_time(F.col("executed_at")).alias("executed_at"),
    )


@query
def external_log(d):
    return answered(d).external_log.select(
        "id", "system_name", "operation", "entity_id", "status", "error_message",
        iso_time(F.col("executed_at")).alias("executed_at"),
    )


@query
def publish_audit(d):
    return published(d).audit.select("step_id", "golden_record_id", "step_name", "status")


@query
def publish_refused_audit(d):
    done = publish.publish_batch(d.applications, d.golden, d.classifications, d.old_logs, AS_OF, actor=("C1", "Admin"))
    return done.refused_audit.select("step_id", "application_id", "step_name", "executed_by", "status", "error_message")


@query
def publish_refused(d):
    return published(d).refused.select("id", "material_code", "reason")


def decided(d):
    return approve.approve_batch(d.applications, d.decisions, d.old_logs, d.principals)


@query
def approve_batch(d):
    return decided(d).applications.select(
        "id", "status", "admin_approved", "admin_approved_by", "admin_comment",
        "dept_approved", "dept_approved_by", "dept_comment",
        iso_time(F.col("updated_at")).alias("updated_at"),
    )


@query
def approve_audit(d):
    return decided(d).audit.select("application_id", "step_id", "step_name", "step_label", "status")


@query
def approve_refused(d):
    return decided(d).refused.select("app_id", "event_id", "action", "status", "reason")


# ---- table writes, schema evolution, feeds ----------------------------------------

PATCHED = ["material_name", "material_desc", "material_type"]


def folded(d):
    order = ["line", "part", "supp", "price"]
    return patch.fold_patches(d.patches, PATCHED, order)


def draft_saves(d):
    apps = d.applications.withColumn("updated_at", F.col("created_at"))
    return patch.save_drafts(apps, folded(d), PATCHED, F.lit(AS_OF).cast("timestamp"))


@query
def draft_patch(d):
    return draft_saves(d)[0].select(
        "id", *PATCHED, "status", iso_time(F.col("updated_at")).alias("updated_at")
    )


@query
def draft_patch_refused(d):
    return draft_saves(d)[1].select("id", "status", "reason")


def saves_by_actor(d):
    """Every request of an order's application as a save of a new description."""
    saves = d.requests.withColumnRenamed("id", "save_id").withColumn("material_desc", F.concat(F.lit("by "), "acted_by"))
    return patch.save_drafts_as(
        d.applications, saves, ["material_desc"], d.principals, d.old_logs, ["at", "save_id"], F.lit(AS_OF).cast("timestamp")
    )


@query
def draft_audit(d):
    return saves_by_actor(d).audit.select("application_id", "step_id", "step_name", "executed_by", "status")


@query
def draft_saved_as(d):
    return saves_by_actor(d).applications.select("id", "material_desc")


@query
def draft_refused_as(d):
    return saves_by_actor(d).refused.select("save_id", "application_id", "acted_by", "reason")


@query
def record_patch(d):
    changed = d.given("part").select(
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("material_name"),
        F.lit("obsolete").alias("status"),
        F.when(F.col("p_size") > 40, F.array(F.lit("status")))
        .when(F.col("p_size") > 20, F.array(F.lit("material_name")))
        .alias("supplied"),
    ).filter(F.col("supplied").isNotNull())
    base = d.golden.withColumn("updated_at", F.col("created_at"))
    return patch.patch_by_id(base, changed, F.lit(AS_OF).cast("timestamp")).select(
        "id", "material_name", "status", iso_time(F.col("updated_at")).alias("updated_at")
    )


@query
def schema_evolve(d):
    # rows of the generation before attachments were known, and of the one after
    old = d.applications.filter(F.col("status") == "published").select("id", "app_no", "status")
    paper = F.struct(F.concat(F.lit("paper-"), "id").alias("id"), F.lit(1).alias("size"))
    new = d.applications.filter(F.col("status") == "draft").select(
        "id", "app_no", "status", F.array(paper).alias("attachments")
    )
    merged = tables.add_missing_columns(old, new)
    return merged.select(
        "id", "app_no", "status",
        F.coalesce(F.size("attachments"), F.lit(0)).cast("bigint").alias("files"),
        F.get("attachments", F.lit(0))["id"].alias("first_file"),
    )


def uploads(d):
    rows = attachments.attachment_rows(d.uploads)
    return attachments.accepted_uploads(d.applications, rows)


@query
def attachments_flat(d):
    return uploads(d)


@query
def attachments_appended(d):
    """The row layout: files on the application, read back one by one."""
    grown = attachments.append_uploads(d.applications, d.uploads, F.lit(AS_OF).cast("timestamp"))
    return attachments.flat_attachments(grown).select("application_id", "attachment_id", "original_name", "size")


@query
def attachment_sizes(d):
    return attachments.upload_sizes(d.applications, uploads(d))


@query
def backfill_templates(d):
    targets = d.given("supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("source_id"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target_id"),
    )
    # targets among the sources have templates already and get no copies
    own = targets.select("source_id", F.col("source_id").alias("target_id")).distinct()
    return backfill.copy_templates(d.templates, targets.unionByName(own)).select(
        "id", "classification_id", "field_name", "is_required", "sort_order"
    )


def two_levels(d):
    return d.classifications.filter(F.col("level") < 3)


def customer_classes(d):
    return d.given("customer").select(
        F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("id"),
        F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("code"),
        F.col("c_name").alias("name"),
        F.when(
            F.col("c_mktsegment") == "BUILDING", F.lit("N99")
        ).otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("parent_id"),
    )


@query
def backfill_level(d):
    return backfill.backfill_level(two_levels(d), customer_classes(d)).select(
        "id", "parent_id", "level", "is_active"
    )


@query
def backfill_level_guarded(d):
    """Level 3 is in use and gets nothing, level 4 is free."""
    added = [backfill.backfill_level(d.classifications, customer_classes(d), level) for level in (3, 4)]
    return added[0].unionByName(added[1]).select("id", "parent_id", "level", "is_active")


@query
def publish_feed(d):
    return feeds.publish_feed(d.golden).select(
        "golden_record_id",
        F.get_json_object("payload", "$.material_code").alias("material_code"),
        F.get_json_object("payload", "$.material_name").alias("material_name"),
        F.get_json_object("payload", "$.status").alias("status"),
        F.get_json_object("payload", "$.version").cast("bigint").alias("version"),
        F.array_join("target_systems", ",").alias("targets"),
    )


@query
def catalog_feed(d):
    return feeds.catalog_feed(d.golden)


# ---- streams ----------------------------------------------------------------------


def streamed(d, name, table):
    """A derived table whose given table ``name`` is read as a stream."""
    source = jobs.read_stream(d.spark, d.sf_dir, name)
    return td.bind(d.spark, d.sf_dir, table, **{name: source})


@query
def stream_validate(d):
    rows = jobs.validate_stream(
        streamed(d, "orders", "applications"), d.classifications, d.templates
    )
    out = rows.select(
        "id", "validation_passed", F.array_join("validation_result.errors", "; ").alias("errors")
    )
    return jobs.drain(d.spark, out)


@query
def stream_dedup(d):
    rows = streamed(d, "orders", "applications").select("id", "material_name")
    checked = jobs.drain_dedup(d.spark, rows, d.golden)
    return checked.select("id", "is_duplicate", F.col("dedup_result.confidence").alias("confidence"))


@query
def stream_lifecycle(d):
    actions = lifecycle.authorised(streamed(d, "events", "actions"), d.principals)
    folder = scratch_path(d.spark, "lifecycle")
    lifecycle_stream(actions, f"{folder}/sink", f"{folder}/checkpoint").awaitTermination()
    return d.spark.read.parquet(f"{folder}/sink").select("app_id", "event_id", "action", "source", "target", "taken")


@query
def stream_audit_dedup(d):
    """The log arrives in files by time, then all of it once more."""
    folder = scratch_path(d.spark, "ingest")
    rows = d.logs.select("id", "step_name", "status", "executed_at")
    for source in ("1", "2"):
        rows.repartitionByRange(4, "executed_at").write.parquet(f"{folder}/in{source}")
    read = lambda: (
        d.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in*")
    )
    jobs.ingest_events(read, f"{folder}/sink", f"{folder}/checkpoint")
    return jobs.ingested(d.spark, f"{folder}/sink").select("id", "step_name", "status")


@query
def stream_status_counts(d):
    """Every application comes as a draft and as it is now, the draft possibly behind."""
    columns = ["id", "status", F.col("created_at").alias("at"), "tie"]
    now = streamed(d, "orders", "applications").withColumn("tie", F.lit("2")).select(*columns)
    draft = streamed(d, "orders", "applications").withColumns({"tie": F.lit("1"), "status": F.lit("draft")})
    folder = scratch_path(d.spark, "counts")
    deltas = jobs.status_deltas(now.unionByName(draft.select(*columns)))
    jobs.live_counts(deltas, f"{folder}/sink", f"{folder}/checkpoint").awaitTermination()
    return jobs.counts_now(d.spark, f"{folder}/sink")


@query
def stream_step_counts(d):
    return jobs.drain(d.spark, jobs.step_counts(streamed(d, "events", "logs")), "complete")
