import random

import pytest
from pyspark.sql import functions as F

from stewardry.functions.text import normalise
from stewardry.operators import dedup
from stewardry.operators.dedup import build_index, check_duplicates


def check(spark, golden, names, **kwargs):
    """``golden``: (code, name, status) rows; returns one dedup result per name."""
    records = spark.createDataFrame(
        [(f"g{i}", *row) for i, row in enumerate(golden)],
        "id string, material_code string, material_name string, status string",
    )
    cands = spark.createDataFrame(list(enumerate(names)), "id int, material_name string")
    out = check_duplicates(cands, records, **kwargs).collect()
    found = {r.id: r.dedup_result for r in out}
    return [found[i] for i in range(len(names))]


def hits(result):
    return [(m.material_code, m.similarity, m.reason) for m in result.similar_materials]


def test_short_and_empty_names(spark):
    golden = [("A", "ab", "active"), ("B", "abc", "active")]
    for result in check(spark, golden, ["", "   ", "ab", None, " ab "]):
        assert (result.is_duplicate, result.confidence, result.similar_materials) == (False, 0.0, [])
    (three,) = check(spark, golden, ["ABC"])
    assert three.is_duplicate and hits(three) == [("B", 1.0, "名称完全相同")]


def test_exact_match_rules(spark):
    golden = [("A", "不锈钢板材304", "active"), ("B", "Obsolete Name", "obsolete")]
    same, spaced, old = check(spark, golden, ["不锈钢板材304", "　不锈钢板材304 \t", "obsolete name"])
    assert hits(same) == hits(spaced) == [("A", 1.0, "名称完全相同")]
    assert same.is_duplicate and same.confidence == 1.0
    assert not old.is_duplicate and old.similar_materials == []


def test_golden_names_are_not_stripped(spark):
    (result,) = check(spark, [("A", " steel plate", "active")], ["steel plate"])
    # not equal as text, but the same words
    assert hits(result) == [("A", 1.0, "关键词重叠 100%")]


def test_overlap_scores(spark):
    golden = [("A", "304 不锈钢 板材 2mm 厚", "active")]
    (near,) = check(spark, golden, ["304 不锈钢 板材 3mm 厚"])
    assert hits(near) == [("A", 0.8, "关键词重叠 80%")] and near.is_duplicate
    golden = [("A", "bolt a b c d e f g", "active")]
    five, four, three = check(
        spark, golden, ["bolt a b c d x y z", "bolt a b c x y z w", "bolt a b x y z w v"]
    )
    assert hits(five) == [("A", 0.62, "关键词重叠 62%")]  # 0.625 rounds to even
    assert hits(four) == [("A", 0.5, "关键词重叠 50%")] and not four.is_duplicate
    assert three.similar_materials == []


def test_names_without_spaces_do_not_overlap(spark):
    (result,) = check(spark, [("A", "碳素结构钢Q235", "active")], ["碳素结构钢Q345"])
    assert result.similar_materials == []


def test_wildcards_are_literal(spark):
    golden = [("A", "乙醇 95% 工业级", "active"), ("B", "乙醇 950 工业级", "active")]
    (result,) = check(spark, golden, ["乙醇 95% 工业级"])
    assert hits(result)[0][:2] == ("A", 1.0)
    (other,) = check(spark, [("A", "abxd e", "active")], ["ab_d e"])
    assert other.similar_materials == []


def test_best_five_of_all(spark):
    golden = [(f"E{i}", "steel plate x", "active") for i in range(3)]
    golden += [(f"P{i}", f"steel plate x{i}", "active") for i in range(9)]
    (result,) = check(spark, golden, ["Steel Plate X"])
    assert [h[0] for h in hits(result)] == ["E0", "E1", "E2", "P0", "P1"]
    golden = [(f"A{i}", f"plates of kind number n{i}", "active") for i in range(6)]
    golden += [("Z", "plates steel thin x", "active")]
    (result,) = check(spark, golden, ["plates steel thin y"])
    assert hits(result) == [("Z", 0.75, "关键词重叠 75%")]  # behind many codes that share letters only


def test_case_variants_do_not_hide_others(spark):
    golden = [(f"A{i}", "STEEL PLATE", "active") for i in range(3)]
    golden += [("B1", "steel plate two", "active")]
    (result,) = check(spark, golden, ["steel plate"])
    assert [h[0] for h in hits(result)] == ["A0", "A1", "A2", "B1"]


def test_ties_round_as_their_binary_value(spark):
    scores = [(m, round(m / 200, 2)) for m in range(100, 201)] + [(115, 0.57)]
    df = spark.createDataFrame([(m / 200, r) for m, r in scores], "s double, r double")
    assert df.filter(dedup.rounded(F.col("s")) != F.col("r")).count() == 0


def test_unique_codes_keep_the_best(spark):
    golden = [("A", "steel plate two", "active"), ("A", "steel plate", "active")]
    (result,) = check(spark, golden, ["steel plate"])
    assert hits(result) == [("A", 1.0, "名称完全相同")]


def test_long_and_special_names(spark):
    golden = [("A", "材料A/B型（测试）", "active"), ("B", "A" * 200, "active"), ("C", "𝒜𝒷𝒸𝒹 x", "active")]
    out = check(spark, golden, ["材料A/B型", "A" * 200, "𝒜𝒷𝒸𝒹 x"])
    assert not out[0].is_duplicate and out[1].is_duplicate and out[2].is_duplicate


def brute_force(golden, name):
    """One candidate at a time over all records."""
    n = name.strip().lower()
    if len(n) < 3:
        return []
    live = sorted((c, raw) for c, raw, s in golden if s == "active")
    found = [(-1.0, 0, c) for c, raw in live if raw.lower() == n]
    if len(n) >= 4:
        for code, raw in live:
            a, b = set(n.split()), set(raw.lower().split())
            score = len(a & b) / max(len(a), len(b))
            if n[:4] in raw.lower() and raw.lower() != n and score >= 0.5:
                found.append((-round(score, 2), 1, code))
    best = []
    for score, _, code in sorted(found):
        if code not in [b[0] for b in best]:
            best.append((code, -score))
    return best[:5]


@pytest.mark.parametrize("seed, wide", [(0, 8), (1, 8), (1, 3), (2, 0), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, wide):
    """By shared word sets, by rare words (no name is short enough for sets) and by both."""
    monkeypatch.setattr(dedup, "CHUNK", [256, 3, 17, 1][seed])
    monkeypatch.setattr(dedup, "WIDE", wide)
    rnd = random.Random(seed)
    words = ["ring", "Ring", "bolt", "bo", "RING", "x", "gear", "plate", "q1", "q2"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5)))
    golden = [(f"M{i:03d}", text(), "active" if rnd.random() < 0.9 else "obsolete") for i in range(200)]
    names = [text() for _ in range(80)]
    out = check(spark, golden, names)
    for name, result in zip(names, out):
        want = brute_force(golden, name)
        assert [(h[0], h[1]) for h in hits(result)] == want, name
        assert result.is_duplicate == any(score >= 0.8 for _, score in want[:3])
        assert result.confidence == (want[0][1] if want else 0.0)


@pytest.mark.parametrize("wide", [0, 20])
@pytest.mark.parametrize("chunk", [256, 1])
def test_equal_after_rounding_goes_by_code(spark, monkeypatch, wide, chunk):
    """9/17 and 10/19 both round to 0.53; the lowest codes come first, however records are filed."""
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    monkeypatch.setattr(dedup, "WIDE", wide if wide == 0 else 8)
    name = "word00 " + " ".join(f"word{i:02d}" for i in range(1, 17))
    shared = name.split()
    golden = [(f"B{i}", " ".join(shared[:9] + [f"b{i}{j}" for j in range(8)]), "active") for i in range(5)]
    golden += [("A1", " ".join(shared[:10] + [f"a{j}" for j in range(9)]), "active")]
    (result,) = check(spark, golden, [name])
    assert [h[:2] for h in hits(result)] == [("A1", 0.53), *((f"B{i}", 0.53) for i in range(4))]


def test_long_and_short_names_meet(spark):
    """One of many words and one of few, in both directions."""
    long = "steel a b c d e f g h"
    golden = [("L", long, "active"), ("S", "steel a b c d", "active"), ("T", "steel a b c", "active")]
    to_long, to_short = check(spark, golden, ["steel a b c d", long])
    assert [h[0] for h in hits(to_long)] == ["S", "T", "L"]  # 1.0, 0.8, 5/9
    assert [h[0] for h in hits(to_short)] == ["L", "S"]


def test_many_equals_do_not_hide_near_ones(spark):
    """Containment hits are no equals, even if those have the lowest codes of the key."""
    golden = [(f"A{i}", "steel plate two", "active") for i in range(9)]
    golden += [(f"B{i}", "Two steel plate", "active") for i in range(6)]
    records = spark.createDataFrame(
        [(f"g{i}", *row) for i, row in enumerate(golden)], "id string, material_code string, material_name string, status string"
    )
    cands = spark.createDataFrame([(1, "steel plate two")], "id int, material_name string")
    rows = dedup.containment_rows(cands, records).collect()
    assert sorted(r.material_code for r in rows) == [f"B{i}" for i in range(5)]


@pytest.mark.parametrize("merge", [0.0, 0.25, 10.0])
def test_index_takes_increments(spark, monkeypatch, merge):
    """After any versions the index answers like one built anew; only changed names are filed."""
    monkeypatch.setattr(dedup.GoldenIndex, "MERGE", merge)
    rnd = random.Random(5)
    words = ["ring", "Ring", "bolt", "bo", "RING", "x", "gear", "plate", "q1"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    rows = {f"M{i:03d}": (text(), "active") for i in range(120)}
    frame = lambda: spark.createDataFrame(
        [(c, c, n, s) for c, (n, s) in rows.items()], "id string, material_code string, material_name string, status string"
    )
    cands = spark.createDataFrame([(i, text()) for i in range(40)] + [(99, "abc")], "id int, material_name string")
    index = build_index(frame())
    answers = lambda **how: sorted(map(str, check_duplicates(cands, **how).select("id", "dedup_result").collect()))
    for step in range(3):
        for code in rnd.sample(sorted(rows), 3):
            rows[code] = (text(), rnd.choice(["active", "obsolete"]))
        rows[f"N{step}"] = (["abc", "ring bolt", "abc"][step], "active")
        rows.pop(rnd.choice(sorted(rows)))
        assert 0 < index.refresh(frame()) <= 10
        assert answers(index=index) == answers(golden=frame())
    assert index.refresh(frame()) == 0
    assert len(index.generations) == (1 if merge == 0.0 else 4 if merge == 10.0 else len(index.generations))


def test_another_similarity_sees_all_records_with_the_prefix(spark):
    golden = [("A", "steel a b c d", "active"), ("B", "xxsteel", "active"), ("C", "iron", "active")]
    same = lambda a, b: F.lit(0.9)
    (result,) = check(spark, golden, ["steel z"], similarity=same)
    assert [h[0] for h in hits(result)] == ["A", "B"]


def test_hot_word_on_both_sides(spark):
    golden = spark.range(20000).select(
        F.col("id").cast("string").alias("id"),
        F.format_string("M%06d", "id").alias("material_code"),
        F.when(F.col("id") % 3 == 0, "hot name here").otherwise(
            F.concat(F.lit("cold name "), F.col("id").cast("string"))
        ).alias("material_name"),
        F.lit("active").alias("status"),
    )
    wanted = F.when(F.col("id") % 2 == 0, "Hot name here").otherwise("cold name thing")
    cands = spark.range(500).select("id", wanted.alias("material_name"))
    df = check_duplicates(cands, golden)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = df.groupBy(F.col("id") % 2, "dedup_result.similar_materials.material_code").count().collect()
    assert sorted((r[0], r[1]) for r in rows) == [
        (0, [f"M{i:06d}" for i in (0, 3, 6, 9, 12)]), (1, [f"M{i:06d}" for i in (1, 2, 4, 5, 7)])
    ]


def test_stream_sees_a_new_version(spark, tmp_path):
    from stewardry.streaming.jobs import dedup_stream

    versions = {1: [("1", "A", "steel plate", "active")], 2: [("1", "A", "steel plate", "active"), ("2", "B", "iron rod", "active")]}
    now = {"v": 1}
    schema = "id string, material_code string, material_name string, status string"
    newest = lambda: (now["v"], spark.createDataFrame(versions[now["v"]], schema))
    rows = spark.createDataFrame([("a", "iron rod")], "id string, material_name string")
    for v in (1, 2):
        now["v"] = v
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        dedup_stream(source, newest, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("batch").select("is_duplicate").collect()
    assert [r[0] for r in out] == [False, True]


def test_index_built_once_serves_many_batches(spark):
    golden = spark.createDataFrame(
        [("1", "A", "steel plate", "active"), ("2", "B", "steel pipe", "active")],
        "id string, material_code string, material_name string, status string",
    )
    index = build_index(golden)
    for name, code in [("steel plate", "A"), ("Steel Pipe ", "B")]:
        cands = spark.createDataFrame([(1, name)], "id int, material_name string")
        (row,) = check_duplicates(cands, index=index).collect()
        assert row.dedup_result.similar_materials[0].material_code == code


def test_normalise_strips_every_white_space(spark):
    df = spark.createDataFrame([("　\x1c A b \n",)], "t string")
    assert df.select(normalise(F.col("t"))).first()[0] == "a b"


def test_a_candidate_name_is_stripped_once(spark):
    cands = spark.createDataFrame([(1, " Abc "), (2, "abc"), (3, " a"), (4, None)], "id int, material_name string")
    rows = cands.repartition(2).select(F.concat("material_name", F.lit(" ")).alias("material_name"))
    out = dedup.candidate_names(rows)
    assert [r.name for r in out.collect()] == ["abc"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
