"""Approval lifecycle: replaying actions against the status machine.

Running a series of actions maps every start status to an end status, and such maps
compose associatively. So the actions of a hot application are cut into short runs, each
run is folded to its map in parallel, and the maps are composed level by level; no task
ever holds all its actions. The machine has no cycle, so a map also carries the few
actions that took effect (at most one per level of the machine). An application whose
actions fit one run is replayed from its status in its row: they meet by one shuffle, and
neither their outcome nor the refused ones need another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ACTION_ROLES, APPLICATION_STATUSES, TRANSITIONS
from ..functions.rows import unfold
from ..session import materialize
from .numbering import ordered_positions

RUN_BITS = 12  # 2**RUN_BITS rows, or maps of the level below, are the most one group collects
LEVELS = 3  # 4096-fold levels between runs and whole applications

TAKEN = "array<struct<pos:bigint,event_id:string,at:timestamp,action:string,source:int,target:int>>"
IDENTITY = (
    f"transform(sequence(1, {len(APPLICATION_STATUSES)}), "
    f"s -> named_struct('state', s, 'taken', cast(array() as {TAKEN})))"
)
STATE_NO = {status: i + 1 for i, status in enumerate(APPLICATION_STATUSES)}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[part for key, value in pairs.items() for part in (F.lit(key), value)])


def moves(action: Column, transitions=TRANSITIONS) -> Column:
    """Per action: the status number each status leads to, null where it is refused."""
    table = {}
    for source, name, target in transitions:
        row = table.setdefault(name, [None] * len(APPLICATION_STATUSES))
        row[STATE_NO[source] - 1] = STATE_NO[target]
    rows = {
        name: F.array(*[F.lit(t).cast("int") for t in row]) for name, row in table.items()
    }
    return F.element_at(_literal_map(rows), action)


def status_no(status: Column) -> Column:
    return F.element_at(_literal_map({s: F.lit(n) for s, n in STATE_NO.items()}), status)


def status_name(number: Column) -> Column:
    """Null for null: asked for, as generated code takes a null place of a full array for -1."""
    name = F.element_at(F.array(*[F.lit(s) for s in APPLICATION_STATUSES]), number)
    return F.when(number.isNotNull(), name)


def authorised(
    actions: DataFrame, principals: DataFrame, owners: DataFrame | None = None
) -> DataFrame:
    """Add ``allowed``: whether the acting user's role may take the action at all.

    With ``owners`` (``app_id, created_by``) applicants may act on their own applications
    only.
    """
    roles = principals.select(F.col("user_id").alias("acted_by"), "role")
    may = _literal_map({a: F.array(*[F.lit(r) for r in rs]) for a, rs in ACTION_ROLES.items()})
    permitted = F.array_contains(F.element_at(may, F.col("action")), F.col("role"))
    judged = actions.join(roles, "acted_by", "left")
    if owners is not None:
        judged = judged.join(owners.select("app_id", "created_by"), "app_id", "left")
        own = F.col("created_by") == F.col("acted_by")
        permitted = permitted & ((F.col("role") != "applicant") | own)
    return judged.withColumn("allowed", F.coalesce(permitted, F.lit(False))).select(
        *actions.columns, "allowed"
    )


def _step(run: Column, event: Column) -> Column:
    """One more action on top of a run."""
    return F.transform(
        run,
        lambda s: F.when(
            F.element_at(event.moves, s.state).isNull(), s
        ).otherwise(
            F.struct(
                F.element_at(event.moves, s.state).alias("state"),
                F.concat(
                    s.taken,
                    F.array(
                        F.struct(
                            event.pos.alias("pos"),
                            event.event_id.alias("event_id"),
                            event.at.alias("at"),
                            event.action.alias("action"),
                            s.state.alias("source"),
                            F.element_at(event.moves, s.state).alias("target"),
                        )
                    ),
                ).alias("taken"),
            )
        ),
    )


def _compose(first: Column, second: Column) -> Column:
    """The map of one run followed by another."""
    return F.transform(
        first,
        lambda s: F.struct(
            F.element_at(second, s.state).state.alias("state"),
            F.concat(s.taken, F.element_at(second, s.state).taken).alias("taken"),
        ),
    )


def _compose_runs(runs: DataFrame, *keys) -> DataFrame:
    """``keys, run``: the maps of each group composed in order."""
    maps = F.sort_array(F.collect_list(F.struct("part", "run")))
    composed = F.aggregate("maps", F.expr(IDENTITY), lambda a, r: _compose(a, r.run))
    grouped = runs.groupBy(*keys).agg(maps.alias("maps"))
    return grouped.select(*grouped.columns[:-1], composed.alias("run"))


def _steps() -> Column:
    """The events of a run that could take effect, with their places and moves."""
    base = F.when(F.col("whole"), F.lit(0)).otherwise(F.shiftleft("part", RUN_BITS))
    steps = F.transform(
        "events",
        lambda e, i: F.struct(
            (base + i).alias("pos"), e.event_id.alias("event_id"), e.at.alias("at"), e.action.alias("action"),
            F.when(e.allowed, moves(e.action)).alias("moves"),
        ),
    )
    return F.filter(steps, lambda e: e.moves.isNotNull())


def _walk() -> Column:
    """A whole application's end status number and effective actions, from its first status."""
    begin = F.struct(status_no(F.col("first.status")).alias("state"), F.expr(f"cast(array() as {TAKEN})").alias("taken"))
    return F.get(F.aggregate(_steps(), F.array(begin), _step), 0)


def run_maps(runs: DataFrame) -> DataFrame:
    """``app_id, run``: the status map of each application that has several runs.

    The runs are folded, and their maps composed in levels.
    """
    part = lambda column: F.shiftright(column, RUN_BITS).alias("part")
    maps = runs.select("app_id", "part", F.aggregate(_steps(), F.expr(IDENTITY), _step).alias("run"))
    for _ in range(LEVELS):
        maps = _compose_runs(maps, "app_id", part("part"))
    return _compose_runs(maps, "app_id")


def place_actions(
    actions: DataFrame, initial: DataFrame | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Actions in replay order: ``app_id, part, events, whole``, written once, read by both outputs.

    ``actions`` has ``app_id, event_id, at, action, allowed``. A row is a run of at most
    ``2**RUN_BITS`` events. It is all of an application's actions (``whole``), or one of the parts
    that a larger application's range-sorted actions are cut into. Actions without an
    application lie apart. With ``initial`` (``app_id, status``) rows hold the status to start
    from as well. ``counted``: rows with ``app_id`` that are cheaper to count than ``actions``.
    """
    at, event_id = F.col("at").cast("timestamp").alias("at"), F.col("event_id").cast("string").alias("event_id")
    allowed = (F.col("allowed") & F.col("app_id").isNotNull()).alias("allowed")
    rows = actions.select("app_id", F.struct(at, event_id, "action", allowed).alias("event"))
    apps = (actions if counted is None else counted).filter(F.col("app_id").isNotNull()).groupBy("app_id")
    large = materialize(apps.agg(F.count("*").alias("n")).filter(F.col("n") > 2**RUN_BITS).select("app_id"))
    several = not large.isEmpty()
    if several:  # read twice
        rows = materialize(rows)
    begins = None if initial is None else initial.select("app_id", F.struct("status").alias("first"))
    apart = F.when(F.col("app_id").isNull(), F.xxhash64("event")).otherwise(F.lit(0)).alias("part")
    small = (rows.join(large, "app_id", "left_anti") if several else rows).select("app_id", apart, "event")
    gathered = [F.sort_array(F.collect_list("event")).alias("events")]
    if begins is not None:  # the first status comes by the same shuffle
        small = small.unionByName(begins.withColumn("part", F.lit(0).cast("bigint")), allowMissingColumns=True)
        gathered.append(F.max("first").alias("first"))
    placed = small.repartition("app_id", "part").groupBy("app_id", "part").agg(*gathered)
    placed = placed.filter(F.size("events") > 0).withColumn("whole", F.lit(True))
    if several:
        ranged = ordered_positions(rows.join(large, "app_id", "left_semi").select("app_id", "event.*"), ["app_id"], ["at", "event_id"])
        event = F.struct("at", "event_id", "action", "allowed")
        cut = ranged.groupBy("app_id", F.shiftright("_pos", RUN_BITS).alias("part")).agg(F.sort_array(F.collect_list(event)).alias("events"))
        if begins is not None:
            cut = cut.join(begins.join(large, "app_id", "left_semi"), "app_id", "left")
        placed = placed.unionByName(cut.withColumn("whole", F.lit(False)))
    return materialize(placed)


def _with_first(placed: DataFrame, initial: DataFrame | None) -> DataFrame:
    """``placed`` with the status to start from in ``first``; null for an unknown application."""
    if "first" in placed.columns:
        return placed
    if initial is None:
        return placed.withColumn("first", F.struct(F.lit("draft").alias("status")))
    return placed.join(initial.select("app_id", F.struct("status").alias("first")), "app_id", "left")


def replay(placed: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``app_id, status, taken``: end status and the actions that took effect, in order.

    ``initial`` gives ``app_id, status`` to start from; without it everything is a draft, unless
    ``placed`` was made with the statuses.
    """
    begun = _with_first(placed, initial).filter(F.col("app_id").isNotNull() & F.col("first").isNotNull())
    ended = begun.filter("whole").select("app_id", _walk().alias("end"))
    if not placed.filter("not whole").isEmpty():
        parts = begun.filter("not whole")
        maps = run_maps(parts).join(parts.select("app_id", "first").distinct(), "app_id")
        ended = ended.unionByName(maps.select("app_id", F.element_at("run", status_no(F.col("first.status"))).alias("end")))
    return ended.select("app_id", status_name(F.col("end.state")).alias("status"), F.col("end.taken").alias("taken"))


def taken_actions(states: DataFrame) -> DataFrame:
    """One row per action that took effect, with its place in the application's history."""
    return unfold(states, "taken", ["app_id"]).select(
        "app_id", (F.col("position") + 1).alias("place"),
        "item.event_id", "item.at", "item.action",
        status_name(F.col("item.source")).alias("source"),
        status_name(F.col("item.target")).alias("target"),
    )


def refused_actions(
    placed: DataFrame, states: DataFrame, initial: DataFrame | None = None
) -> DataFrame:
    """Actions without effect, with the status they met and why they were refused.

    The status met is the target of the last effective action before. A whole application is
    walked again in its row; of a larger one the short ``taken`` list is looked up in ``states``.
    """
    begun = _with_first(placed, initial)
    kept = ["app_id", "part", "whole", "first", "events"]
    runs = begun.filter("whole").select(*kept, _walk()["taken"].alias("taken"))
    if not placed.filter("not whole").isEmpty():
        parts = begun.filter("not whole").select(*kept).join(states.select("app_id", "taken"), "app_id", "left")
        runs = runs.unionByName(parts)
    rows = unfold(runs, "events", ["app_id", "part", "whole", "first", "taken"]).select(
        "app_id", "first", "taken", "item.*",
        (F.when(F.col("whole"), F.lit(0)).otherwise(F.shiftleft("part", RUN_BITS)) + F.col("position")).alias("pos"),
    )
    before = F.filter("taken", lambda t: t.pos < F.col("pos"))
    last = F.get(before, F.size(before) - 1)
    met = F.when(F.size(before) > 0, status_name(last.target)).otherwise(F.col("first.status"))
    effective = F.coalesce(F.exists("taken", lambda t: t.pos == F.col("pos")), F.lit(False))
    return rows.filter(~effective).select(
        "app_id", "event_id", "at", "action",
        met.alias("status"),
        F.when(F.col("app_id").isNull(), "no_application")
        .when(F.col("action").isNull(), "no_decision")
        .when(~F.col("allowed"), "role")
        .when(met.isNull(), "unknown")
        .otherwise("status")
        .alias("reason"),
    )
