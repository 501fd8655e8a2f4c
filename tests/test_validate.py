from pyspark.sql import functions as F

from stewardry.functions import json_values
from stewardry.operators.constraints import CONSTRAINTS, Constraint, quarantine, with_violations
from stewardry.operators.quality import run_quality_tests
from stewardry.operators.validate import ExtraCheck, validate
from stewardry.sources.tables import append_rows, load_rows, read_table

GOOD = {
    "material_name": "测试不锈钢板材304", "classification_id": "cls-child", "material_type": "raw",
    "attribute_values": '{"material_grade": "304不锈钢", "thickness": "2.0", "width": "1000"}',
}


def results(spark, classes, templates, rows, **kwargs):
    apps = [{"id": str(i), **GOOD, **row} for i, row in enumerate(rows)]
    df = load_rows(spark, apps, "material_applications")
    out = validate(df, classes, templates, **kwargs).select("id", "validation_result")
    found = {int(r.id): r.validation_result for r in out.collect()}
    return [found[i] for i in range(len(rows))]


def by_name(result):
    return {c["check"]: (c.passed, c.message) for c in result.checks}


def test_good_row_lists_checks_in_order(spark, classes, templates):
    (result,) = results(spark, classes, templates, [{}])
    assert result.passed and result.errors == []
    assert [c["check"] for c in result.checks] == [
        "required_material_name", "required_classification_id", "required_material_type",
        "name_length", "classification_exists", "material_type",
        "attr_material_grade", "attr_thickness",
    ]
    assert by_name(result)["classification_exists"] == (True, "分类: 金属材料")
    assert by_name(result)["attr_material_grade"] == (True, "材质等级: 304不锈钢")


def test_required_fields_and_name_length(spark, classes, templates):
    names = ["", None, "abcd", "abcde", "   ", "x" * 200, "x" * 201]
    out = results(spark, classes, templates, [{"material_name": n} for n in names])
    assert [by_name(r)["required_material_name"][0] for r in out] == [
        False, False, True, True, True, True, True,
    ]
    # a missing name passes the length check, white space counts as text
    assert [by_name(r)["name_length"][0] for r in out] == [
        True, True, False, True, False, True, False,
    ]
    assert by_name(out[2])["name_length"][1] == "名称长度 4 < 5"
    assert out[6].errors == ["物料名称太长（最多200个字符）"]
    assert out[0].errors == ["必填字段缺失: material_name"]


def test_class_and_type(spark, classes, templates):
    out = results(
        spark, classes, templates,
        [{"classification_id": "no"}, {"classification_id": ""}, {"classification_id": None},
         {"material_type": "bogus"}, {"material_type": None}, {"classification_id": "cls-off"}],
    )
    assert out[0].errors == ["所选分类不存在"]
    for missing in out[1:3]:
        assert "classification_exists" not in by_name(missing)
        assert missing.errors == ["必填字段缺失: classification_id"]
    assert out[3].errors == ["无效的物料类型: bogus"]
    assert out[4].errors == ["必填字段缺失: material_type"]
    assert by_name(out[4])["material_type"] == (True, "类型: None")
    assert out[5].passed  # an inactive class still exists


def test_presence_of_json_values(spark, classes, templates):
    values = {
        "null": False, '""': False, "0": False, "0.0": False, "0.00": False, "-0": False, "0e5": False,
        "false": False, "[]": False, "{}": False, '"0"': True, '"false"': True, '" "': True,
        "true": True, "1": True, "-2.5": True, "1e-30": True, "[0]": True, '{"a": null}': True,
    }
    rows = [{"attribute_values": f'{{"material_grade": {v}, "thickness": 1}}'} for v in values]
    out = results(spark, classes, templates, rows)
    assert [by_name(r)["attr_material_grade"][0] for r in out] == list(values.values())
    rows = [{"attribute_values": v} for v in (None, "not json", "[1]", "3", '{"thickness": 2}')]
    for result in results(spark, classes, templates, rows):
        assert "必填属性缺失: 材质等级" in result.errors


def test_extra_checks(spark, classes, templates):
    extra = [ExtraCheck("no_percent", ~F.contains("material_name", F.lit("%")), "percent sign")]
    good, bad = results(
        spark, classes, templates, [{}, {"material_name": "乙醇 95% 工业级"}], extra=extra
    )
    assert by_name(good)["no_percent"][0] and bad.errors == ["percent sign"]


def test_no_shuffle_of_applications(spark, classes, templates, tmp_path):
    stored = []
    for name, df in [
        ("material_classifications", classes), ("attribute_templates", templates),
        ("material_applications", load_rows(spark, [{"id": "1", **GOOD}], "material_applications")),
    ]:
        append_rows(df, str(tmp_path / name), name)
        stored.append(read_table(spark, str(tmp_path / name), name))
    plan = validate(stored[2], *stored[:2])._jdf.queryExecution().executedPlan().toString()
    # the only exchange is the pre-aggregation of the template table
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_constraints_and_quarantine(spark):
    df = spark.createDataFrame(
        [("1", "0101", "ok", 2), ("2", "x" * 11, None, 4), ("3", None, "n", None)],
        "id string, code string, name string, level int",
    )
    clean, bad = quarantine(df, CONSTRAINTS["material_classifications"])
    assert [r.id for r in clean.collect()] == ["1"]
    assert {r.id: r.violations for r in bad.collect()} == {
        "2": ["code:max_length", "name:required", "level:range"],
        "3": ["code:required", "level:required"],
    }
    kinds = spark.createDataFrame([("text",), ("texts",), (None,)], "field_type string")
    rule = [Constraint("field_type", pattern="^(text|number)$")]
    assert [len(r.violations) for r in with_violations(kinds, rule).collect()] == [0, 1, 0]


def test_quality(spark):
    rows = [("C1", "12345", "k"), ("", "1234", "k"), (None, "x" * 201, ""), ("C2", "x" * 200, None)]
    df = spark.createDataFrame(rows, "material_code string, material_name string, classification_id string")
    out = [([t.passed for t in r.quality_results], r.all_passed) for r in run_quality_tests(df).collect()]
    assert out == [
        ([True, True, True], True), ([False, False, True], False),
        ([False, False, False], False), ([True, True, False], False),
    ]


def test_repeated_keys_and_written_numbers(spark):
    cases = {
        '{"w": 1, "w": "last"}': (True, "last"), '{"w": 2.0}': (True, "2.0"), '{"w": 2}': (True, "2"),
        '{"w": -2.50}': (True, "-2.5"), '{"w": 0.0}': (False, "0.0"), '{"w": 12345678901234567890}': (True, "12345678901234567890"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    item = json_values.typed(json_values.object_entries(F.col("j"))["w"])
    rows = df.select("j", json_values.is_present(item).alias("p"), json_values.value_text(item).alias("t")).collect()
    assert {r.j: (r.p, r.t) for r in rows} == cases


def test_errors_are_picked_once(spark, classes, templates):
    rows = load_rows(spark, [{"id": "a", "material_name": "ab"}], "material_applications").repartition(2)
    out = validate(rows, classes, templates).select("id", "validation_result", "validation_passed")
    row = out.first()
    assert not row.validation_passed and not row.validation_result.passed and len(row.validation_result.errors) == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the failed checks, of which the errors are taken
    assert plan.count("lambdafunction(NOT ") == 1
