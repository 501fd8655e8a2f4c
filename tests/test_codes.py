import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stewardry.functions.text import pad_number
from stewardry.operators.codes import _issued_by_stem, advance_rules, application_numbers, generate_codes
from stewardry.operators.numbering import number_within


def codes(spark, classes, rules, requests, golden=(), issued=(), year=2026):
    """``requests``: (id, class, type, rule id); returns material codes by id."""
    req = spark.createDataFrame(
        requests, "id int, classification_id string, material_type string, code_rule_id string"
    )
    gold = spark.createDataFrame(list(golden), "classification_id string, material_code string")
    given = spark.createDataFrame([(c,) for c in issued], "material_code string")
    out = generate_codes(req, classes, rules, gold, given, year, ["id"])
    return out, {r.id: r.material_code for r in out.collect()}


def test_rule_codes_are_consecutive_and_shared_by_types(spark, classes, rules):
    kinds = ["raw", "semi", "raw"]
    out, found = codes(spark, classes, rules, [(i, "cls-child", k, None) for i, k in enumerate(kinds)])
    # prefix M in front of parent code M01
    assert found == {0: "MM01-0101-00001", 1: "MM01-0101-00002", 2: "MM01-0101-00003"}
    after = {r.id: r.current_seq for r in advance_rules(rules, out).collect()}
    assert after == {"rule-1": 3, "rule-2": 0, "rule-0": 98}


def test_named_rules(spark, classes, rules):
    _, found = codes(
        spark, classes, rules,
        [(1, "cls-child", "finished", "rule-0"), (2, "cls-child", "raw", "rule-0"),
         (3, "cls-child", "raw", "nope"), (4, "cls-child", "raw", "")],
    )
    # an inactive rule may be named; numbers grow past their width; unknown names fall to
    # the default code and no name means the class rule
    assert found == {1: "FIN2699-Z", 2: "RAW26100-Z", 3: "M01-0101-00001", 4: "MM01-0101-00001"}


def test_default_codes_and_unknown_class(spark, classes, rules):
    golden = [("cls-leaf", f"anything-{i}x") for i in range(42)]
    _, found = codes(
        spark, classes, rules,
        [(1, "cls-leaf", "raw", None), (2, "cls-leaf", "raw", None), (3, "cls-parent", "raw", None),
         (4, "cls-lost", "raw", None), (5, "missing", "raw", None)],
        golden=golden, issued=["00-0901-00007", "00-0901-99999"],
    )
    assert found == {
        1: "0101-010101-00043", 2: "0101-010101-00044", 3: "M01-M01-00001",
        4: "00-0901-100000", 5: None,
    }


def test_padding_keeps_long_numbers(spark):
    df = spark.createDataFrame([(7,), (99999,), (100000,)], "n long")
    assert [r[0] for r in df.select(pad_number(F.col("n"), 5)).collect()] == ["00007", "99999", "100000"]


def test_application_numbers(spark):
    new = spark.createDataFrame(
        [("b", "2026-01-02 00:00:00"), ("a", "2026-01-02 00:00:00"), ("c", "2025-05-01 00:00:00")],
        "id string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    old = spark.createDataFrame([("SQ-2026-00007",), ("SQ-2026-00002",), ("SQ-2024-00009",)], "app_no string")
    number = lambda how: {r.id: r.app_no for r in application_numbers(new, old, how).collect()}
    assert number("max") == {"a": "SQ-2026-00008", "b": "SQ-2026-00009", "c": "SQ-2025-00001"}
    assert number("count")["a"] == "SQ-2026-00003"
    with pytest.raises(ValueError):
        application_numbers(new, old, "other")


def test_hot_key_numbers_are_dense_and_ordered(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", f"k{i % 50}"]), rnd.randint(0, 40), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    numbered = number_within(df, ["k"], ["t", "id"]).collect()
    groups = defaultdict(list)
    for r in numbered:
        groups[r.k].append((r.t, r.id, r.n))
    assert sum(map(len, groups.values())) == 5000
    for found in groups.values():
        assert [n for *_, n in sorted(found)] == list(range(1, len(found) + 1))


def test_hot_key_is_spread_over_ranges(spark):
    from stewardry.operators.numbering import PART_BITS, ordered_positions

    df = spark.range(40000).select(F.when(F.col("id") >= 0, "hot").alias("k"), "id")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        placed = ordered_positions(df, ["k"], ["id"])
    finally:
        spark.conf.set(setting, "true")
    sizes = placed.groupBy(F.shiftright("_pos", PART_BITS).alias("p")).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 10000


def test_an_issued_code_is_read_once(spark):
    codes = ["A-1", "A-12", "A-x", "-5", "B-99999999999999999999", "", None]
    issued = spark.createDataFrame([(c,) for c in codes], "made string").select(
        F.concat("made", F.lit("")).alias("material_code")
    )
    out = _issued_by_stem(issued, "material_code", "^(.+-)([0-9]+)$")
    assert {(r.stem, r.issued, r.highest) for r in out.collect()} == {("A-", 2, 12), ("B-", 1, None)}
    # one for the stem, one for the number
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
