from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stewardry.plans import overview
from stewardry.plans.approve import approve_batch
from stewardry.plans.dashboard import dashboard_stats
from stewardry.plans.publish import apply_results, publish_batch
from stewardry.plans.submit import create_batch, submit_batch
from stewardry.sources.tables import load_rows

AS_OF = datetime(2026, 5, 1, 12)
AT = lambda: F.lit(AS_OF).cast("timestamp")
GOOD = '{"material_grade": "304不锈钢", "thickness": "2.5"}'


@pytest.fixture(scope="module")
def chain(spark, classes, templates, rules):
    """Three applications taken from creation to publication."""
    new = spark.createDataFrame(
        [("a", "乙醇 95% 工业级", "cls-child", GOOD), ("b", "不锈钢 板材 304", "cls-child", GOOD),
         ("c", "不锈钢 板材 316", "non-existent-id", GOOD)],
        "id string, material_name string, classification_id string, attribute_values string",
    ).withColumn("material_type", F.lit("raw")).withColumn("created_by", F.lit("user001"))
    none = lambda name: load_rows(spark, [], name)
    drafts = create_batch(new, none("material_applications"), AT())
    golden = load_rows(
        spark,
        [{"id": "g0", "material_code": "X-1", "material_name": "不锈钢 板材 304", "classification_id": "cls-child", "material_type": "raw"}],
        "golden_records",
    )
    submitted = submit_batch(drafts, classes, templates, rules, golden, none("audit_logs"), AS_OF)
    decisions = spark.createDataFrame(
        [("d1", "a", "admin", True, "ok", 1), ("d2", "a", "dept", True, "fine", 2), ("d3", "b", "admin", False, "duplicate", 3),
         ("d4", "b", "dept", True, "late", 4), ("d5", "c", "admin", True, "draft", 5)],
        "decision_id string, application_id string, stage string, approved boolean, comment string, minute int",
    ).select("*", F.lit("admin001").alias("acted_by"), F.lit("王").alias("acted_by_name"),
             (AT() + F.make_dt_interval(mins=F.col("minute"))).alias("at"))
    people = spark.createDataFrame([("admin001", "admin")], "user_id string, role string")
    decided = approve_batch(submitted.applications, decisions, submitted.audit, people)
    logs = submitted.audit.unionByName(decided.audit)
    published = publish_batch(decided.applications, golden, classes, logs, AS_OF)
    return drafts, golden, submitted, decided, published, logs


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in df.collect()}


def test_created_drafts(chain):
    drafts = chain[0]
    assert by_id(drafts, "app_no", "status") == {
        "a": ("SQ-2026-00001", "draft"), "b": ("SQ-2026-00002", "draft"), "c": ("SQ-2026-00003", "draft"),
    }


def test_submitted(chain):
    _, _, submitted, *_ = chain
    assert by_id(submitted.applications, "status", "material_code", "is_duplicate") == {
        "a": ("pending_admin", "MM01-0101-00001", False), "b": ("pending_admin", "MM01-0101-00002", True),
        "c": ("draft", None, False),
    }
    refused = by_id(submitted.applications, "validation_result")["c"][0]
    assert not refused.passed and refused.errors == ["所选分类不存在"]
    assert {r.id: r.current_seq for r in submitted.rules.collect()}["rule-1"] == 2
    steps = sorted((r.step_id, r.step_name, r.status) for r in submitted.audit.collect())
    assert steps[:4] == [
        ("SQ-2026-00001-S1", "validate", "success"), ("SQ-2026-00001-S2", "dedup_check", "success"),
        ("SQ-2026-00001-S3", "code_generate", "success"), ("SQ-2026-00001-S4", "submit", "success"),
    ]
    assert steps[-1] == ("SQ-2026-00003-S1", "validate", "failed") and len(steps) == 9


def test_decided(chain):
    _, _, _, decided, *_ = chain
    assert by_id(decided.applications, "status", "admin_approved", "admin_comment", "dept_approved", "dept_comment") == {
        "a": ("approved", True, "ok", True, "fine"), "b": ("rejected", False, "duplicate", False, None),
        "c": ("draft", False, None, False, None),
    }
    assert sorted((r.step_id, r.status) for r in decided.audit.collect()) == [
        ("SQ-2026-00001-S5", "success"), ("SQ-2026-00001-S6", "success"), ("SQ-2026-00002-S5", "failed"),
    ]
    assert {(r.event_id, r.status) for r in decided.refused.collect()} == {("d4", "rejected"), ("d5", "draft")}


def test_published(chain):
    *_, published, _ = chain
    (record,) = published.golden.collect()
    assert (record.material_code, record.classification_path, record.status, record.version) == (
        "MM01-0101-00001", "原材料 (M01) / 金属材料 (0101)", "active", 1,
    )
    assert (record.btp_published, record.om_synced, record.om_entity_fqn) == (False, False, None)
    assert by_id(published.applications, "status", "updated_at") == {"a": ("published", AS_OF)}
    assert [(r.step_id, r.step_name, r.status) for r in published.audit.collect()] == [
        ("SQ-2026-00001-S7", "create_gr", "success")
    ]
    assert published.publish_feed.count() == published.catalog_feed.count() == 1


def test_publishing_again_adds_nothing(spark, chain, classes):
    _, golden, _, decided, published, logs = chain
    known = golden.unionByName(published.golden)
    again = publish_batch(decided.applications, known, classes, logs, AS_OF)
    assert again.golden.isEmpty() and again.audit.isEmpty()
    assert [(r.id, r.reason) for r in again.refused.collect()] == [("a", "recorded")]


def test_publish_reasons(spark, classes):
    looped = classes.unionByName(load_rows(
        spark, [{"id": "loop", "code": "L", "name": "Loop", "level": 2, "parent_id": "loop"}], "material_classifications"
    ))
    row = lambda i, code, cls="cls-child": {
        "id": i, "app_no": i, "material_code": code, "classification_id": cls, "status": "approved", "material_name": "steel plate"
    }
    apps = load_rows(spark, [row("a", "X"), row("b", "X"), row("c", None), row("d", ""), row("e", "Y", "loop"), row("f", "G")], "material_applications")
    golden = load_rows(spark, [{"id": "g", "material_code": "G"}], "golden_records")
    out = publish_batch(apps, golden, looped, load_rows(spark, [], "audit_logs"), AS_OF)
    assert by_id(out.refused, "reason") == {
        "b": ("code_taken",), "c": ("no_code",), "d": ("no_code",), "e": ("no_path",), "f": ("code_taken",)
    }
    assert [r.application_id for r in out.golden.collect()] == ["a"]


RESULTS = "result_id string, golden_record_id string, system string, success boolean, reference string, response string, error_message string, minute int"


def test_answers(spark, chain):
    _, _, _, decided, published, logs = chain
    rows = [
        ("1", "gr-a", "btp", False, None, None, "timeout", 1), ("2", "gr-a", "btp", True, "B-9", "{}", None, 3),
        ("3", "gr-a", "openmetadata", False, None, None, "down", 4), ("4", "gr-unknown", "btp", True, "B-1", None, None, 5),
    ]
    results = spark.createDataFrame(rows, RESULTS).withColumn("at", AT() + F.make_dt_interval(mins=F.col("minute")))
    out = apply_results(published.golden, decided.applications, results, logs.unionByName(published.audit))
    (record,) = out.golden.collect()
    assert (record.btp_published, record.btp_sync_id, record.om_synced, record.om_entity_fqn) == (True, "B-9", False, None)
    assert sorted((r.step_id, r.step_name, r.status, r.error_message) for r in out.audit.collect()) == [
        ("SQ-2026-00001-S10", "om_test", "success", None), ("SQ-2026-00001-S8", "publish_btp", "success", None),
        ("SQ-2026-00001-S9", "sync_om", "failed", "down"),
    ]
    assert sorted((r.system_name, r.entity_id, r.status) for r in out.external_log.collect()) == [
        ("btp", "gr-a", "failed"), ("btp", "gr-a", "success"), ("btp", "gr-unknown", "success"), ("openmetadata", "gr-a", "failed"),
    ]
    none = apply_results(published.golden, decided.applications, results.limit(0), logs)
    assert none.audit.isEmpty() and none.golden.first().btp_published is False


def test_no_decision_and_roles(spark, chain):
    drafts, _, submitted, *_ = chain
    people = spark.createDataFrame([("m", "admin"), ("d", "dept_approver")], "user_id string, role string")
    rows = [("n1", "a", "admin", None, "m", 1), ("n2", "a", "admin", False, "d", 2), ("n3", "a", "admin", True, "m", 3), ("n4", None, "admin", True, "m", 4)]
    decisions = spark.createDataFrame(rows, "decision_id string, application_id string, stage string, approved boolean, acted_by string, minute int").select(
        "*", F.lit(None).cast("string").alias("comment"), F.lit(None).cast("string").alias("acted_by_name"),
        (AT() + F.make_dt_interval(mins=F.col("minute"))).alias("at"),
    )
    out = approve_batch(submitted.applications, decisions, submitted.audit, people)
    assert by_id(out.applications.filter("id = 'a'"), "status") == {"a": ("pending_dept",)}
    assert {(r.event_id, r.reason) for r in out.refused.collect()} == {("n1", "no_decision"), ("n2", "role"), ("n4", "no_application")}


def test_overview(spark, chain, classes):
    _, golden, _, decided, published, logs = chain
    rows = [("1", "gr-a", "btp", True, "B-9", None, None, 1), ("2", "gr-a", "openmetadata", True, "catalog.a", None, None, 2)]
    results = spark.createDataFrame(rows, RESULTS).withColumn("at", AT() + F.make_dt_interval(mins=F.col("minute")))
    logs = logs.unionByName(published.audit)
    answered = apply_results(published.golden, decided.applications, results, logs)
    records = golden.unionByName(answered.golden)
    parts = overview.overview(records, decided.applications, classes, logs.unionByName(answered.audit))
    assert parts["summary"].first().asDict() == {
        "metadata_assets": 2, "om_synced": 1, "btp_published": 1, "quality_tests": 4, "traceable_applications": 3,
    }
    assert {r.id for r in parts["nodes"].collect()} == {
        "source-applications", "btp", "openmetadata", "app-a", "gr-gr-a", "gr-g0",
    }
    assert {(r["from"], r.to) for r in parts["edges"].collect()} == {
        ("app-a", "gr-gr-a"), ("gr-gr-a", "btp"), ("gr-gr-a", "openmetadata"),
    }
    tests = {r.id: (r.test_name, r.status, r.message) for r in parts["quality_tests"].collect()}
    assert tests["validate-gr-a"] == ("申请质量校验", "passed", "质量规则通过")
    assert tests["om-gr-a-0"] == ("material_code_not_null", "passed", "物料编码非空")
    traces = {r.application_id: r.step_count for r in parts["traces"].collect()}
    assert traces == {"a": 10, "b": 5, "c": 1}


def test_dashboard(chain, classes):
    _, golden, _, decided, *_ = chain
    row = dashboard_stats(decided.applications, golden, classes).first()
    assert (row.total_applications, row.approved, row.rejected, row.pending, row.total_classifications) == (3, 1, 1, 0, 4)


def test_submit_by_actors(spark, chain, classes, templates, rules):
    drafts, golden, *_ = chain
    people = spark.createDataFrame(
        [("user001", "applicant"), ("user002", "applicant"), ("m", "admin"), ("d", "dept_approver")], "user_id string, role string"
    )
    rows = [("a", "user002", "B"), ("a", "user001", "A"), ("b", "m", "M"), ("b", "d", "D"), ("x", "m", "M"), ("c", None, None)]
    requests = spark.createDataFrame(rows, "application_id string, acted_by string, acted_by_name string")
    none = load_rows(spark, [], "audit_logs")
    out = submit_batch(drafts, classes, templates, rules, golden, none, AS_OF, requests, people)
    assert {(r.application_id, r.acted_by): r.reason for r in out.refused.collect()} == {
        ("a", "user002"): "role", ("b", "d"): "role", ("x", "m"): "unknown", ("c", None): "role"
    }
    assert out.applications.columns == drafts.columns
    assert by_id(out.applications, "status") == {"a": ("pending_admin",), "b": ("pending_admin",)}
    steps = out.audit.filter("step_name = 'submit'").collect()
    assert {r.application_id: (r.executed_by, r.executed_by_name) for r in steps} == {"a": ("user001", "A"), "b": ("m", "M")}


def test_a_failed_draft_keeps_its_columns(spark, classes, templates, rules):
    row = {"id": "q", "material_name": "ab", "classification_id": "cls-child", "material_type": "raw", "material_code": "KEEP-1", "is_duplicate": True}
    drafts = load_rows(spark, [row], "material_applications")
    golden, logs = load_rows(spark, [], "golden_records"), load_rows(spark, [], "audit_logs")
    (out,) = submit_batch(drafts, classes, templates, rules, golden, logs, AS_OF).applications.collect()
    assert (out.status, out.material_code, out.is_duplicate, out.validation_passed) == ("draft", "KEEP-1", True, False)
