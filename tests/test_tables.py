from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stewardry.functions.text import iso_time, safe_file_name
from stewardry.operators import attachments, hierarchy, lookup, patch
from stewardry.plans import backfill
from stewardry.schemas import APPLICATIONS, TABLES
from stewardry.sources import feeds, tables
from stewardry.sources.tables import load_rows

NOW = datetime(2026, 5, 1, 12)
AT = lambda: F.lit(NOW).cast("timestamp")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_insert_fills_defaults_and_round_trips(spark, tmp_path):
    path = str(tmp_path / "apps")
    tables.append_rows(spark.createDataFrame([("1", "n")], "id string, material_name string"), path, "material_applications")
    tables.append_rows(spark.createDataFrame([("2", "pending_admin")], "id string, status string"), path, "material_applications")
    back = tables.read_table(spark, path, "material_applications")
    assert back.schema == APPLICATIONS
    assert rows(back, "id", "status", "is_duplicate", "admin_approved") == [
        ("1", "draft", False, False), ("2", "pending_admin", False, False),
    ]
    for name, schema in TABLES.items():
        assert tables.load_rows(spark, [], name).schema == schema


def test_old_files_read_with_new_columns(spark, tmp_path):
    path = str(tmp_path / "gen")
    spark.createDataFrame([("1",)], "id string").write.parquet(path)
    tables.conform_table(spark.createDataFrame([("2",)], "id string"), "material_applications").write.mode("append").parquet(path)
    assert rows(tables.read_evolved(spark, path), "id", "status") == [("1", None), ("2", "draft")]
    assert rows(tables.read_table(spark, path, "material_applications"), "id", "attachments") == [("1", None), ("2", None)]


def test_versions_do_not_touch_each_other(spark, tmp_path):
    one = tables.write_version(spark.range(1), str(tmp_path), 1)
    two = tables.write_version(spark.range(2), str(tmp_path), 2)
    assert (spark.read.parquet(one).count(), spark.read.parquet(two).count()) == (1, 2)


def test_external_log_layout(spark):
    df = feeds.external_log(spark.createDataFrame([("1", "btp", "publish")], "id string, system_name string, operation string"))
    assert df.schema == TABLES["external_system_logs"] and df.count() == 1


def test_feeds_are_json_lines(spark, tmp_path):
    golden = tables.load_rows(spark, [{"id": "g", "material_code": "C-1", "material_name": "名"}], "golden_records")
    path = str(tmp_path / "feed")
    feeds.write_feed(feeds.publish_feed(golden), path)
    feeds.write_feed(feeds.catalog_feed(golden, "my.prefix"), path)
    back = spark.read.json(path).orderBy("payload").collect()
    assert back[0].entity_fqn == "my.prefix.C-1"
    assert '"material_name":"名","status":"published","version":1' in back[1].payload
    assert back[1].target_systems == ["SAP-S4HANA", "SAP-Ariba"]


def test_patch_sets_named_columns_only(spark):
    base = spark.createDataFrame([("1", "a", "x", None), ("2", "b", "y", None)], "id string, name string, note string, updated_at timestamp")
    change = spark.createDataFrame([("1", None, "new", ["name"]), ("9", "z", "z", ["name"])], "id string, name string, note string, supplied array<string>")
    out = patch.patch_by_id(base, change, AT())
    assert rows(out, "id", "name", "note") == [("1", None, "x"), ("2", "b", "y")]
    assert {r.id: r.updated_at for r in out.collect()} == {"1": NOW, "2": None}


def test_draft_save(spark):
    base = spark.createDataFrame([("1", "a", "x", "draft"), ("2", "b", "y", "approved")], "id string, name string, note string, status string")
    saved = spark.createDataFrame([("1", 1, "first", None), ("1", 2, "second", None), ("2", 3, "no", "no"), ("7", 4, "no", None)], "id string, seq int, name string, note string")
    folded = patch.fold_patches(saved, ["name", "note"], ["seq"])
    out, refused = patch.save_drafts(base, folded, ["name", "note"], AT())
    assert rows(out, "id", "name", "note") == [("1", "second", "x"), ("2", "b", "y")]
    assert rows(refused, "id", "reason") == [("2", "not_draft"), ("7", "unknown")]


def test_page_bounds(spark):
    df = spark.createDataFrame([(str(i), NOW) for i in range(5)], "id string, created_at timestamp")
    for skip, limit in [(-1, 10), (0, 0), (0, 501)]:
        with pytest.raises(ValueError):
            lookup.page(df, "created_at", skip, limit)
    assert [r.id for r in lookup.page(df, "created_at", 1, 2).collect()] == ["1", "2"]
    seen, after = [], None
    while rows_ := lookup.page_after(df, "created_at", after, 1).collect():
        seen += [r.id for r in rows_]
        after = (rows_[-1].created_at, rows_[-1].id)
    assert seen == [r.id for r in lookup.page(df, "created_at", 0, 100).collect()]
    plan = lookup.page(df, "created_at", 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_pages_by_rank(spark):
    """Every page equals offset and limit, nulls last; a deep page opens one range."""
    rows_ = [(f"{i:04d}", None if i % 11 == 0 else NOW.replace(microsecond=(i * 7919) % 997)) for i in range(2000)]
    df = spark.createDataFrame(rows_, "id string, created_at timestamp").repartition(8)
    pages = lookup.RankedPages(df, "created_at")
    assert sum(n for *_, n in pages.ranges) == 2000
    for skip, limit in [(0, 1), (0, 500), (7, 13), (990, 20), (1800, 500), (1999, 5), (2000, 5), (5000, 1)]:
        want = [r.id for r in lookup.page(df, "created_at", skip, limit).collect()]
        assert [r.id for r in pages.page(skip, limit).collect()] == want
    with pytest.raises(ValueError):
        pages.page(-1, 5)
    number, first, n = pages.ranges[-1]
    plan = pages.page(first + n // 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(_range" in plan and "GreaterThanOrEqual(_place" in plan
    empty = lookup.RankedPages(df.limit(0), "created_at")
    assert empty.page().count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_audits_carried_over_batches(spark, seed):
    """After any batches the carried findings are those of a full audit."""
    import random

    from stewardry.operators import constraints as cs

    rnd = random.Random(seed)
    children = {f"c{i}": f"t{rnd.randint(0, 12)}" for i in range(40)}
    targets = {f"t{i}" for i in range(8)}
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    child = lambda: frame([(k, v) for k, v in children.items()], "id string, ref string")
    ids = lambda names: frame([(n,) for n in names], "id string")
    full = lambda: sorted((i, v) for i, v in children.items() if v not in targets)
    repeated = lambda: sorted((v, n) for v, n in __import__("collections").Counter(children.values()).items() if n > 1)
    found = frame([("r", *x) for x in full()], "relation string, id string, value string")
    copies = frame([("k", *x) for x in repeated()], "key string, value string, copies long")
    for _ in range(3):
        changed = set(rnd.sample(sorted(children), 5))
        touched = {children[c] for c in changed}
        for c in list(changed)[:4]:
            children[c] = f"t{rnd.randint(0, 12)}"
        children.pop(list(changed)[4])
        children[f"n{rnd.random()}"] = "t3"
        new = [c for c in children if c.startswith("n")]
        changed |= set(new)
        touched |= {children[c] for c in changed if c in children}
        out, more = set(rnd.sample(sorted(targets), 2)), {f"t{rnd.randint(8, 12)}"}
        out -= more
        more -= targets
        targets = targets - out | more
        found = cs.orphans_after(found, "r", child(), "ref", ids(targets), ids(changed), ids(more), ids(out))
        found = frame([tuple(r) for r in found.collect()], found.schema)
        assert sorted((r.id, r.value) for r in found.collect()) == full()
        copies = cs.repeats_after(copies, "k", child(), "ref", frame([(t,) for t in touched], "value string"))
        copies = frame([tuple(r) for r in copies.collect()], copies.schema)
        assert sorted((r.value, r.copies) for r in copies.collect()) == repeated()


def test_pages_go_through_rows_without_a_key(spark):
    """More null keys than a page holds: every row once, nulls last."""
    rows_ = [(f"{i:02d}", NOW if i % 3 == 0 else None) for i in range(17)]
    df = spark.createDataFrame(rows_, "id string, created_at timestamp")
    seen, after = [], None
    while found := lookup.page_after(df, "created_at", after, 3).collect():
        seen += [r.id for r in found]
        after = (found[-1].created_at, found[-1].id)
    assert seen == sorted([i for i, at in rows_ if at]) + sorted([i for i, at in rows_ if not at])


def test_lists(spark, classes, rules):
    assert [r.code for r in lookup.active_classifications(classes, parent_id="cls-parent").collect()] == ["0101"]
    assert [r.code for r in lookup.active_classifications(classes, level=2).collect()] == ["0101", "0901"]
    with pytest.raises(ValueError):
        lookup.active_classifications(classes, level=4)
    assert rows(lookup.rule_of_class(rules), "id") == [("rule-1",)]
    assert lookup.by_id(classes, "nope").isEmpty()
    keys = spark.createDataFrame([("cls-leaf",), ("nope",)], "id string")
    assert rows(lookup.by_keys(classes, keys), "id", "code") == [("cls-leaf", "010101"), ("nope", None)]


def test_search_is_literal_and_ignores_case(spark):
    df = spark.createDataFrame([("100% Steel", None), ("1005 steel", "ST%"), (None, None)], "material_name string, material_code string")
    find = lambda q: lookup.search(df, q, lookup.GOLDEN_SEARCH).count()
    assert (find("0% s"), find("STEEL"), find("st%"), find("")) == (1, 2, 1, 2)


def test_visibility(spark):
    df = spark.createDataFrame([("1", "u1"), ("2", "u2")], "id string, created_by string")
    seen = lambda user, role: lookup.visible_to(df, user, role).count()
    assert (seen("u1", "applicant"), seen("x", "admin"), seen("x", "data_admin"), seen("u1", "dept_approver")) == (1, 2, 2, 0)


def test_hierarchy(spark, classes):
    paths = {r.id: (r.path, r.complete) for r in hierarchy.paths(classes).collect()}
    assert paths["cls-leaf"] == ("原材料 (M01) / 金属材料 (0101) / 钢板 (010101)", True)
    assert paths["cls-lost"] == ("Lost (0901)", True)
    majors = {r.id: r.major_code for r in hierarchy.major_codes(classes).collect()}
    assert majors == {"cls-parent": "M01", "cls-child": "M01", "cls-leaf": "0101", "cls-off": "M01", "cls-lost": "00"}
    (root,) = hierarchy.tree_nested(classes).collect()
    assert [(c.code, [g.code for g in c.children]) for c in root.children] == [("0101", ["010101"]), ("0102", [])]
    cycle = spark.createDataFrame([("a", "b", "A", "a", 2), ("b", "a", "B", "b", 2)], "id string, parent_id string, code string, name string, level int")
    assert rows(hierarchy.paths(cycle), "id", "complete") == [("a", False), ("b", False)]
    chain = [{"id": str(i), "code": f"c{i}", "name": "n", "level": 1, "parent_id": str(i - 1) if i else None} for i in range(20)]
    chain += [{"id": "x", "code": "cx", "name": "n", "level": 1, "parent_id": "x"}, {"id": "y", "code": "cy", "name": "n", "level": 1, "parent_id": "x"}]
    deep = {r.id: (r.path, r.complete) for r in hierarchy.paths(load_rows(spark, chain, "material_classifications")).collect()}
    assert deep["19"] == (" / ".join(f"n (c{i})" for i in range(20)), True)
    assert deep["x"] == deep["y"] == (None, False)


def test_file_names(spark):
    cases = {
        "plan.pdf": "plan.pdf", "a/b/plan.pdf": "plan.pdf", "c:\\x\\y.dwg": "c:_x_y.dwg", "": "attachment",
        "dir/": "dir", "/": "attachment", ".": "attachment", "a/.": "a", "..": "..", "图纸/零件 1.pdf": "零件 1.pdf",
    }
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    assert [r[0] for r in df.select(safe_file_name(F.col("f"))).collect()] == list(cases.values())


def test_attachments(spark):
    apps = tables.load_rows(spark, [{"id": "1"}, {"id": "2", "status": "approved"}], "material_applications")
    uploads = spark.createDataFrame(
        [("1", "f2", "b.pdf", "", 20, NOW), ("1", "f1", "x/a.pdf", "text/plain", 10, datetime(2026, 1, 1)), ("2", "f3", "c", None, 5, NOW)],
        "application_id string, id string, file_name string, content_type string, size int, uploaded_at timestamp",
    ).withColumn("uploaded_by", F.lit("u")).withColumn("uploaded_by_name", F.lit("U"))
    made = attachments.attachment_rows(uploads)
    grown = attachments.append_attachments(apps, made, AT())
    again = attachments.append_attachments(grown, made.filter("attachment.id = 'f2'"), AT())
    assert rows(attachments.attachment_sizes(again), "application_id", "files", "total_size") == [("1", 3, 50), ("2", 0, 0)]
    flat = attachments.flat_attachments(grown).collect()
    assert [(r.attachment_id, r.original_name, r.content_type) for r in flat] == [
        ("f1", "a.pdf", "text/plain"), ("f2", "b.pdf", "application/octet-stream"),
    ]
    assert attachments.find_attachment(grown, "1", "f2").first().download_url == "/api/applications/1/attachments/f2"
    assert attachments.find_attachment(grown, "1", "f3").isEmpty()
    accepted = attachments.accepted_uploads(apps, made)
    assert rows(attachments.upload_sizes(apps, accepted), "application_id", "files", "total_size") == [("1", 2, 30), ("2", 0, 0)]


def test_backfills(spark, classes, templates):
    seed = spark.createDataFrame([("n1", "020101", "New", "cls-off"), ("n2", "030101", "Orphan", "nope")], "id string, code string, name string, parent_id string")
    assert backfill.backfill_level(classes, seed).count() == 0  # level 3 is in use
    two = classes.filter("level < 3")
    assert rows(backfill.backfill_level(two, seed), "id", "level", "is_active") == [("n1", 3, True)]
    targets = spark.createDataFrame([("cls-child", "cls-leaf"), ("cls-child", "cls-child")], "source_id string, target_id string")
    copies = backfill.copy_templates(templates, targets)
    assert rows(copies, "id", "classification_id") == [(f"tpl-{i}-cls-leaf", "cls-leaf") for i in (1, 2, 3)]
    assert backfill.copy_templates(templates.unionByName(copies), targets).isEmpty()


def test_iso_time(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 2, 3, 4, 5),), (datetime(2026, 1, 2, 3, 4, 5, 60),), (None,)], "t timestamp")
    assert [r[0] for r in df.select(iso_time(F.col("t"))).collect()] == ["2026-01-02T03:04:05", "2026-01-02T03:04:05.000060", None]


def test_uploads_are_shuffled_before_their_texts_are_made(spark, monkeypatch):
    rows = [{"id": f"a{i}", "status": "draft" if i % 3 else "published"} for i in range(30)]
    apps = load_rows(spark, rows, "material_applications")
    uploads = spark.range(200).select(
        F.concat(F.lit("a"), F.pmod("id", F.lit(33)).cast("string")).alias("application_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"),
        F.lit("dir/plan.pdf").alias("file_name"), F.lit("").alias("content_type"), F.col("id").alias("size"), F.lit("u").alias("uploaded_by"),
        F.lit("U").alias("uploaded_by_name"), F.timestamp_seconds(F.lit(1000) - F.col("id")).alias("uploaded_at"),
    )
    at = F.lit("2026-01-01").cast("timestamp")
    want = attachments.append_attachments(apps, attachments.attachment_rows(uploads), at)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = attachments.append_uploads(apps, uploads, at)
        plan = got._jdf.queryExecution().executedPlan().toString()
        grouped = plan[plan.index("collect_list") : plan.index(" AS attachment#")]
        assert "Exchange" not in grouped
        assert {str(r) for r in got.collect()} == {str(r) for r in want.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert attachments.flat_attachments(got).count() == sum(1 for i in range(200) if i % 33 < 30 and i % 33 % 3)
