import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stewardry.constants import ACTION_ROLES, TRANSITIONS
from stewardry.operators import lifecycle as lc
from stewardry.streaming.lifecycle import lifecycle_stream

START = datetime(2026, 1, 1)
ACTIONS = sorted({a for _, a, _ in TRANSITIONS}) + ["edit"]
TABLE = {(s, a): t for s, a, t in TRANSITIONS}
SCHEMA = "app_id string, event_id string, at timestamp, action string, acted_by string"


def frame(spark, rows):
    """(application, event number, action[, user]) rows, one minute apart."""
    data = [
        (r[0], f"e{r[1]:06d}", START + timedelta(minutes=r[1]), r[2], r[3] if len(r) > 3 else None)
        for r in rows
    ]
    return spark.createDataFrame(data, SCHEMA)


def run(spark, rows, initial=None, principals=None):
    actions = frame(spark, rows)
    free = actions.withColumn("allowed", F.lit(True)) if principals is None else lc.authorised(actions, principals)
    placed = lc.place_actions(free)
    states = lc.replay(placed, initial)
    refused = lc.refused_actions(placed, states, initial)
    return (
        {r.app_id: (r.status, [t.event_id for t in r.taken]) for r in states.collect()},
        {(r.app_id, r.event_id): (r.status, r.reason) for r in refused.collect()},
    )


def walk(rows, first=lambda app: "draft"):
    status, taken, refused = {}, {}, {}
    for app, number, action in sorted(rows, key=lambda r: r[1]):
        now = status.setdefault(app, first(app))
        taken.setdefault(app, [])
        if (now, action) in TABLE:
            status[app] = TABLE[now, action]
            taken[app].append(f"e{number:06d}")
        else:
            refused[app, f"e{number:06d}"] = (now, "status")
    return {a: (status[a], taken[a]) for a in status}, refused


def test_whole_chain_and_rejections(spark):
    chain = ["submit", "admin_approve", "dept_approve", "publish"]
    rows = [("full", i, a) for i, a in enumerate(chain)]
    rows += [("no", 10, "submit"), ("no", 11, "admin_reject"), ("no", 12, "submit")]
    rows += [("late", 20, "submit"), ("late", 21, "admin_approve"), ("late", 22, "dept_reject")]
    rows += [("idle", 30, "publish"), ("odd", 40, "edit")]
    states, refused = run(spark, rows)
    assert {a: s for a, (s, _) in states.items()} == {
        "full": "published", "no": "rejected", "late": "rejected", "idle": "draft", "odd": "draft",
    }
    assert refused == {
        ("no", "e000012"): ("rejected", "status"), ("idle", "e000030"): ("draft", "status"),
        ("odd", "e000040"): ("draft", "status"),
    }


def test_a_null_application_is_refused(spark):
    rows = [(None, 1, "submit"), ("a", 2, "submit")]
    states, refused = run(spark, rows)
    assert states == {"a": ("pending_admin", ["e000002"])}
    assert refused == {(None, "e000001"): ("draft", "no_application")}


@pytest.mark.parametrize("bits", [12, 3])
def test_random_replay_equals_a_walk(spark, monkeypatch, bits):
    monkeypatch.setattr(lc, "RUN_BITS", bits)  # 3: an application's actions fall into many runs
    rnd = random.Random(bits)
    rows = [
        (rnd.choice(["hot", f"a{rnd.randint(0, 40)}"]), i, rnd.choice(ACTIONS)) for i in range(1500)
    ]
    assert run(spark, rows) == walk(rows)


def test_replay_from_given_states(spark):
    initial = spark.createDataFrame(
        [("a", "approved"), ("b", "pending_dept"), ("quiet", "draft")], "app_id string, status string"
    )
    rows = [("a", 1, "submit"), ("a", 2, "publish"), ("b", 3, "dept_reject"), ("gone", 4, "submit")]
    states, refused = run(spark, rows, initial)
    assert {a: s for a, (s, _) in states.items()} == {"a": "published", "b": "rejected"}
    assert refused == {
        ("a", "e000001"): ("approved", "status"), ("gone", "e000004"): (None, "unknown"),
    }


def test_roles(spark):
    people = spark.createDataFrame(
        [("u", "applicant"), ("m", "admin"), ("d", "dept_approver"), ("g", "guest")],
        "user_id string, role string",
    )
    rows = [
        ("x", 1, "submit", "g"), ("x", 2, "submit", "u"), ("x", 3, "admin_approve", "u"),
        ("x", 4, "admin_approve", "d"), ("x", 5, "admin_approve", "m"), ("x", 6, "dept_approve", "d"),
        ("x", 7, "publish", "d"), ("x", 8, "publish", None), ("x", 9, "publish", "m"),
    ]
    states, refused = run(spark, rows, principals=people)
    assert states == {"x": ("published", ["e000002", "e000005", "e000006", "e000009"])}
    assert {e for _, e in refused} == {"e000001", "e000003", "e000004", "e000007", "e000008"}
    assert {r for _, r in refused.values()} == {"role"}
    assert ACTION_ROLES["submit"] == ["applicant", "admin", "data_admin"]


def test_applicants_act_on_their_own_only(spark):
    people = spark.createDataFrame([("u", "applicant"), ("v", "applicant"), ("m", "admin")], "user_id string, role string")
    owners = spark.createDataFrame([("x", "u"), ("y", "u"), ("z", "u")], "app_id string, created_by string")
    rows = [("x", 1, "submit", "u"), ("y", 2, "submit", "v"), ("z", 3, "submit", "m")]
    out = lc.authorised(frame(spark, rows), people, owners).collect()
    assert {r.app_id: r.allowed for r in out} == {"x": True, "y": False, "z": True}


def test_hot_application_in_a_stream(spark, tmp_path, monkeypatch):
    """Half of every batch is one application; statuses are merged on the way; equals the batch."""
    from stewardry.streaming import lifecycle as stream_of

    monkeypatch.setattr(stream_of, "MERGE", 2)
    rnd = random.Random(9)
    rows = [("hot" if i % 2 else f"a{rnd.randint(0, 5)}", i, rnd.choice(ACTIONS)) for i in range(2400)]
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in range(5):
        frame(spark, rows[part * 480 : part * 480 + 480]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source).withColumn("allowed", F.lit(True))
        lifecycle_stream(stream, sink, check).awaitTermination()
    out = spark.read.parquet(sink).orderBy("at").collect()
    want, refused = walk(rows)
    assert len(out) == len(rows) and {r.app_id: r.target for r in out} == {a: s for a, (s, _) in want.items()}
    assert {(r.app_id, r.event_id): (r.source, "status") for r in out if not r.taken} == refused


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    from stewardry.streaming.lifecycle import replay_batch

    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    batches = [frame(spark, [("a", 1, "submit")]), frame(spark, [("a", 2, "admin_approve"), ("b", 3, "publish")])]
    for nth in (0, 1, 1):
        replay_batch(batches[nth].withColumn("allowed", F.lit(True)), nth, sink, state)
    out = {(r.app_id, r.event_id): (r.source, r.target, r.taken) for r in spark.read.parquet(sink).collect()}
    assert len(out) == spark.read.parquet(sink).count() == 3
    assert sorted(v[2] for v in out.values()) == [False, True, True] and ("pending_admin", "pending_dept", True) in out.values()


def test_stream_keeps_state_across_batches(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"a{rnd.randint(0, 12)}", i, rnd.choice(ACTIONS)) for i in range(300)]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):  # three files, one per micro-batch, in time order
        frame(spark, rows[part * 100 : part * 100 + 100]).coalesce(1).write.mode("append").parquet(source)
        stream = (
            spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            .withColumn("allowed", F.lit(True))
        )
        lifecycle_stream(stream, sink, str(tmp_path / "check")).awaitTermination()
        if part == 1:  # the events of the first file once more
            frame(spark, rows[:100]).coalesce(1).write.mode("append").parquet(source)
    out = spark.read.parquet(sink).orderBy("at").collect()
    want, refused = walk(rows)
    last = {r.app_id: r.target for r in out}
    assert len(out) == 300 and last == {a: s for a, (s, _) in want.items()}
    assert {(r.app_id, r.event_id): (r.source, "status") for r in out if not r.taken} == refused


def test_one_shuffle_of_actions(spark, monkeypatch):
    """Applications of one run: neither outcome nor refused actions shuffle what was placed."""
    rnd = random.Random(3)
    rows = [(f"a{rnd.randint(0, 90)}", i, rnd.choice(ACTIONS)) for i in range(900)]
    actions = frame(spark, rows).withColumn("allowed", F.lit(True))
    initial = spark.createDataFrame([(f"a{i}", "pending_admin") for i in range(0, 91)], "app_id string, status string")
    placed = lc.place_actions(actions, initial)
    states = lc.replay(placed)
    refused = lc.refused_actions(placed, states)
    for out in (states, refused):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want, left = walk(rows, lambda app: "pending_admin")
    assert {r.app_id: (r.status, [t.event_id for t in r.taken]) for r in states.collect()} == want
    assert {(r.app_id, r.event_id): (r.status, r.reason) for r in refused.collect()} == left


@pytest.mark.parametrize("bits", [12, 3])
def test_placed_with_statuses_equals_given_later(spark, monkeypatch, bits):
    """Unknown applications, unknown statuses, no application; in one run and in many."""
    monkeypatch.setattr(lc, "RUN_BITS", bits)
    rnd = random.Random(bits)
    names = ["hot", "hot", "x", "odd", "none", "gone", None]
    rows = [(rnd.choice(names), i, rnd.choice(ACTIONS)) for i in range(400)]
    rows += [(None, i, None) for i in range(400, 420)]
    actions = frame(spark, rows).withColumn("allowed", F.pmod(F.substring("event_id", 2, 9).cast("int"), F.lit(3)) > 0)
    initial = spark.createDataFrame(
        [("hot", "draft"), ("x", "approved"), ("odd", "strange"), ("none", None), ("idle", "draft")], "app_id string, status string"
    )
    later, at_once = lc.place_actions(actions), lc.place_actions(actions, initial)
    states = [lc.replay(later, initial), lc.replay(at_once)]
    refused = [lc.refused_actions(later, states[0], initial), lc.refused_actions(at_once, states[1])]
    for pair in (states, refused):
        one, two = ({str(r.asDict(True)) for r in df.collect()} for df in pair)
        assert one == two
    kinds = {(r.app_id, r.status) for r in states[1].collect()}
    assert {a for a, _ in kinds} == {"hot", "x", "odd", "none"} and ("odd", None) in kinds and ("none", None) in kinds
    out = [(r.app_id, r.status, r.reason) for r in refused[1].collect()]
    assert {o[2] for o in out if o[0] is None} == {"no_application"} and {o[1] for o in out if o[0] == "odd"} == {"strange"}
    assert ("gone", None, "unknown") in out and {o[1] for o in out if o[0] == "gone"} == {None}


def test_a_batch_is_read_once(spark, tmp_path):
    """A micro-batch comes out of the state store; reading it again would run that again."""
    from stewardry.streaming.lifecycle import replay_batch

    read = spark.sparkContext.accumulator(0)
    rows = frame(spark, [("a", 1, "submit"), ("b", 2, "publish"), ("a", 3, "admin_approve")]).withColumn("allowed", F.lit(True))
    batch = spark.createDataFrame(rows.rdd.map(lambda r: (read.add(1), r)[1]), rows.schema)
    replay_batch(batch, 0, str(tmp_path / "out"), str(tmp_path / "state"))
    assert read.value == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 3
