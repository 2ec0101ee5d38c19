"""Replays dealt by tasks, by satellite and by tasks again, against the operators that list schedules and offsets as rows."""

import random

from pyspark.sql import functions as F

from orbweave.operators import book, candidates, downlinks, firstfit, lookahead, objective, replay
from orbweave.operators.trajectories import task_order
from orbweave.plans import registry
from orbweave.tables import RUNS, Scenarios

from .conftest import SF


def exchanges(df):
    """Hash exchanges that carry rows of windows, offsets or schedules: those that are dealt by satellite, task or part."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and ("satellite_id" in x or "task_id" in x or "REPARTITION" in x)]


def test_windows_are_dealt_once_with_steps_and_schedules(spark):
    t = Scenarios(spark, SF)
    got, names = t.dealt_window, ["scenario_id", "task_id", "step", "priority", "duration_s", "window_id", "satellite_id", "orbit_number", "start_s", "end_s", "seed"]
    want = t.placed_window.join(task_order(t.task).select("scenario_id", "task_id", "step"), ["scenario_id", "task_id"])
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    of = [F.struct(F.lit(r).alias("schedule_id"), (F.col("picks").bitwiseAND(1 << i) > 0).alias("has")) for i, r in enumerate(RUNS)]
    picked = got.select("scenario_id", "task_id", "window_id", F.inline(F.array(*of))).where("has").select("scenario_id", "schedule_id", "task_id", "window_id")
    assert sorted(map(tuple, picked.collect())) == sorted(map(tuple, t.assignment.select(picked.columns).collect()))
    assert len(exchanges(got)) == 1


def test_windows_know_what_each_schedule_accepts_and_what_fits(spark):
    t = Scenarios(spark, SF)
    w = book.with_offsets(t, t.dealt_window)
    got = book.replayed_windows(w, "choices", w.columns, 2).where("scenario_id = 'S1997'").collect()
    rows = replay.replayed(t).where("scenario_id = 'S1997'").cache()
    taken = {(r.schedule_id, r.task_id): r.accepted for r in rows.collect()}
    assert {(RUNS[i], r.task_id): r[f"taken{i}"] for r in got for i in range(3) if r.picks >> i & 1} == taken
    fits = {(RUNS[i], r.window_id, x // 2, x % 2) for r in got for i in range(3) for x in r[f"fit{i}"]}
    want = replay.blocked_choices(t, rows).withColumn("gap", F.when(F.col("first").isNull(), 0).otherwise(F.col("step") - F.col("first"))).where("gap < 2").collect()
    assert fits == {(r.schedule_id, r.window_id, r.k, r.gap) for r in want}
    loads = {(RUNS[i], r.window_id): r[f"load{i}"][0] for r in got for i in range(3)}
    assert all(loads[r.schedule_id, r.window_id] == r.load for r in want)


def test_labels_travel_as_windows(spark):
    """Neither schedules nor offsets are dealt as rows: windows by task, satellite and task again (F1)."""
    assert len(exchanges(registry.queries()["expert_labels"](spark, SF))) == 3


def test_states_come_from_short_tables_of_loads(spark):
    """The same states as from one line of all loads and totals, and what loads lack to a later mean as from a range join."""
    t = Scenarios(spark, SF)
    got = book.with_lacking(book.states_of(t, book.task_book(t, "steps")), ["duration_s"])
    rows = replay.judged(t).cache()
    states = objective.with_states(objective.replay_steps(rows, t.task), objective.scenario_totals(t.task, t.satellite)).cache()
    names = ["scenario_id", "schedule_id", "step", "task_id", "taken", "profit0", "n0", "early0", "busy0", "own_below", "own_low", "below0", "low0", "possible", "tasks", "required_s", "sats"]
    base = objective.lacking_at(states, states.select("scenario_id", "schedule_id", "step", F.col("duration_s").alias("extra"))).withColumnRenamed("base", "base_0")
    want = states.join(base, ["scenario_id", "schedule_id", "step"])
    assert sorted(map(tuple, got.select(*names, "base_0").collect())) == sorted(map(tuple, want.select(*names, "base_0").collect()))


def test_choices_are_never_dealt_as_rows(spark):
    """The last plan of greedy_actions reads tasks in buckets: nothing of a task or a satellite is dealt again (F2)."""
    assert not exchanges(registry.queries()["greedy_actions"](spark, SF))


def test_predictions_and_limits_are_judged_where_windows_were_dealt(spark):
    """Windows are dealt once for prediction_quality (F7), and once more, by satellite, for capacity_replay."""
    assert len(exchanges(registry.queries()["prediction_quality"](spark, SF))) == 1
    assert len(exchanges(registry.queries()["capacity_replay"](spark, SF))) == 2


def test_downlinks_are_audited_by_satellite(spark):
    """The same violations as from assignments that are dealt with their downlinks, with unknown satellites, times and stations."""
    rng = random.Random(10)
    rows = [("S", rng.choice("xy"), i, rng.choice([1, 2, 3, None]), s := rng.choice([None, *range(60)]), d := rng.randint(0, 9), None if s is None else s + d) for i in range(200)]
    a = spark.createDataFrame(rows, "scenario_id string, schedule_id string, task_id long, satellite_id long, sat_start_s long, duration_s long, sat_end_s long")
    comm = spark.createDataFrame([(i, rng.choice([1, 2, None]), rng.choice([7, 8, None]), rng.randrange(60)) for i in range(40)], "comm_id long, satellite_id long, station_id long, start_s long")
    want = downlinks.downlink_violations(downlinks.with_downlinks(a, comm))
    got = downlinks.audited(a, comm).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_selections_share_their_items(spark, monkeypatch):
    """All heuristics go over the same windows (F3), dealt by tasks before (F5, F6), and choose what each does alone."""
    t, seen = Scenarios(spark, SF), []
    monkeypatch.setattr(replay, "first_fits", lambda items, world: seen.append(items) or firstfit.first_fits(items, world))
    names = list(replay.ORDERS)
    got = {(r.algorithm, r.scenario_id, r.task_id, r.window_id, r.k, r.priority) for r in replay.first_fit_selections(t, names).collect()}
    assert seen[0].count() == seen[0].select("scenario_id", "window_id").distinct().count() and len(exchanges(seen[0])) == 1
    for name in names:
        rank = seen[0].withColumn("rank", F.array(*[F.expr(x).cast("long") for x in replay.ORDERS[name]]))
        alone = {(name, r.scenario_id, r.task_id, r.window_id, r.k) for r in firstfit.first_fits(rank.drop("part"), ["scenario_id"]).collect()}
        assert alone == {x[:5] for x in got if x[0] == name} and alone


def test_values_of_two_steps_are_those_of_branches(spark):
    """Forced actions and the choices of the next step meet in blocks, with the same values as branches that are rows."""
    want = lookahead.branch_values(Scenarios(spark, SF), 2)
    got = registry.queries()["horizon_values"](spark, SF).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_linked_candidates_stay_with_their_tasks(spark):
    """Candidates of a task are collected where its windows were dealt."""
    t = Scenarios(spark, SF)
    w = t.dealt_window.withColumn("step_s", F.lit(10).cast("long"))
    got = candidates.offsets_of(candidates.windows_of(w, t.satellite, 3, ["part"]), ["part"])
    tasks = got.groupBy("part", "scenario_id", "task_id").agg(F.count("*").alias("n"))
    assert len(exchanges(tasks)) == 1
    assert sorted(map(tuple, got.drop("part").collect())) == sorted(map(tuple, candidates.candidates_of(t, 3).collect()))
