from datetime import datetime

from pyspark.sql import functions as F

from stewardry import constants as C
from stewardry.functions import labels
from stewardry.operators import audit
from stewardry.sources.tables import load_rows

T = lambda minute: datetime(2026, 3, 1, 10, minute)


def apps(spark):
    return load_rows(
        spark,
        [{"id": "a", "app_no": "SQ-2026-00001"}, {"id": "b", "app_no": "SQ-2026-00002"}],
        "material_applications",
    )


def logs(spark, rows):
    """(id, application, step, minute[, step id]) rows."""
    return load_rows(
        spark,
        [
            {"id": r[0], "application_id": r[1], "step_name": r[2], "executed_at": T(r[3]),
             "status": "success", "executed_by": "u", "step_id": r[4] if len(r) > 4 else None,
             "step_label": C.STEP_LABELS.get(r[2], r[2])}
            for r in rows
        ],
        "audit_logs",
    )


def test_step_ids_continue_and_unknown(spark):
    old = logs(spark, [("0", "a", "create_draft", 0, "SQ-2026-00001-S1"), ("1", "a", "submit", 1, "SQ-2026-00001-S2")])
    new = logs(spark, [("2", "a", "validate", 5), ("3", "b", "submit", 4), ("4", "a", "dedup_check", 6),
                       ("5", None, "submit", 1), ("6", "zz", "submit", 2), ("7", "b", "archive", 4)])
    out = {r.id: r for r in audit.record_events(new.drop("step_id", "step_label"), apps(spark), old).collect()}
    assert {i: r.step_id for i, r in out.items()} == {
        "2": "SQ-2026-00001-S3", "4": "SQ-2026-00001-S4", "3": "SQ-2026-00002-S1",
        "7": "SQ-2026-00002-S2", "5": "UNKNOWN-S1", "6": "UNKNOWN-S2",
    }
    assert out["2"].step_label == "质量校验" and out["7"].step_label == "archive"
    assert out["2"].status_label == "成功"


def test_labels(spark):
    df = spark.createDataFrame([(s,) for s in C.STEP_LABELS], "s string")
    assert [r[0] for r in df.select(labels.step_label(F.col("s"))).collect()] == list(C.STEP_LABELS.values())
    df = spark.createDataFrame([(1,), (3,), (9,)], "n int")
    assert [r[0] for r in df.select(labels.level_label(F.col("n"))).collect()] == ["大类", "小类", "9"]


def test_trace_order_and_own_rows_only(spark):
    table = logs(spark, [("3", "a", "code_generate", 3), ("1", "a", "submit", 1), ("2", "b", "submit", 0), ("0", "a", "validate", 1)])
    out = audit.application_trace(table, "a").collect()
    assert [r.step_name for r in out] == ["validate", "submit", "code_generate"]
    assert out[0].executed_at == "2026-03-01T10:01:00"


def test_summary_and_latest(spark):
    table = logs(spark, [("1", "a", "submit", 1), ("2", "a", "validate", 3), ("3", "a", "validate", 3), ("4", None, "submit", 9)])
    out = {r.app_no: r for r in audit.trace_summary(apps(spark), table).collect()}
    assert (out["SQ-2026-00001"].step_count, out["SQ-2026-00001"].last_step) == (3, "质量校验")
    empty = out["SQ-2026-00002"]
    assert (empty.step_count, empty.last_step, empty.last_executed_at) == (0, None, None)
    latest = {r.step_name: r.id for r in audit.latest_steps(table).collect()}
    assert latest == {"submit": "1", "validate": "3"}


def test_a_logged_step_id_is_made_and_read_once(spark):
    """The filter on what was read off may not move into the join that the step ids come from."""
    lines = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", None)], "app string, line int")
    apps = spark.createDataFrame([("a", "SQ-1"), ("b", "SQ-2"), ("c", "SQ-3")], "app string, app_no string")
    old = lines.join(apps, "app").select(F.concat("app_no", F.lit("-S"), F.col("line").cast("string")).alias("step_id"))
    steps = spark.createDataFrame([("SQ-1",), ("SQ-2",), ("SQ-3",)], "app_no string")
    joined = steps.join(audit.logged_steps(old), "app_no", "left")
    assert {r.app_no: r.logged for r in joined.collect()} == {"SQ-1": 2, "SQ-2": 1, "SQ-3": None}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("concat(") == 1


def test_logged_steps_of_odd_ids(spark):
    ids = ["A-S1", "A-S1-S2", "A-S1-S2", "-S3", "A-S", "A-Sx", "S1", "", None, "A\n-S1", "B-S7\n"]
    old = spark.createDataFrame([(i,) for i in ids], "step_id string")
    assert {r.app_no: r.logged for r in audit.logged_steps(old).collect()} == {"A": 1, "A-S1": 2, "B": 1}
