"""Steps that were changed for larger tables: what they no longer list or sort, against plain loops."""

import random

from pyspark.sql import functions as F

from orbweave.operators import candidates, conflicts, firstfit, grouped, replay, rules, sweeps
from orbweave.tables import Scenarios

from .conftest import SF


def test_candidates_are_listed_after_the_windows_are_sorted(spark):
    t = Scenarios(spark, SF)
    plan = candidates.candidates_of(t).select("place_rank", "window_id", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # from the top
    rows = candidates.candidates_of(t).where("scenario_id = 'S1996'").collect()
    tasks = {}
    for r in rows:
        tasks.setdefault(r.task_id, []).append(r)
    for own in tasks.values():
        assert sorted(r.place_rank for r in own) == list(range(1, len(own) + 1))
    three = {(r.task_id, r.place_rank, r.window_id, r.k) for r in candidates.candidates_of(t, 3).where("scenario_id = 'S1996'").collect()}
    assert three == {(r.task_id, r.place_rank, r.window_id, r.k) for r in rows if r.place_rank <= 3}


def test_placements_are_counted_as_listed(spark):
    t = Scenarios(spark, SF)
    pairs = candidates.downlink_pairs(candidates.candidates_of(t), t.comm_window).groupBy("scenario_id", "satellite_id")
    want = pairs.agg(F.countDistinct("window_id").alias("windows"), F.count("*").alias("placements"), F.sum("gs_start_s").alias("start_sum"))
    got = candidates.placements_by_satellite(candidates.windows_of(t.placed_window, t.satellite), t.comm_window)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_distinct_values_by_orbit(spark):
    rows = spark.createDataFrame([("S", 1, 7), ("S", 1, 7), ("S", 2, 7), ("S", 2, 8), ("S", None, 9), ("T", 1, None)], "scenario_id string, orbit_number long, x long")
    got = {tuple(r) for r in rules.distinct_by_orbit(rows, "x", "n").select("scenario_id", "orbit_number", "whole", "n").collect()}
    assert got == {("S", 1, False, 1), ("S", 2, False, 2), ("S", None, False, 1), ("S", None, True, 3), ("T", 1, False, 0), ("T", None, True, 0)}


def test_rows_of_a_crowded_satellite_are_judged_as_by_the_loop(spark):
    rng = random.Random(4)
    rows = [("S", "x", i, rng.choice([5, 6, None]), i, rng.randint(1, 3), rng.randint(1, 5), d := rng.randint(5, 15), rng.randint(0, 999), s := rng.randrange(1500), s + d) for i in range(400)]
    schema = "scenario_id string, schedule_id string, task_id long, satellite_id long, window_id long, orbit_number long, priority long, duration_s long, seed long, sat_start_s long, sat_end_s long"
    satellite = spark.createDataFrame([(5, "non_agile"), (6, "agile")], "satellite_id long, maneuverability string")
    turn = lambda agile, g: 10.0 if not agile else 11.66 if g <= 10 else 5 + g / 1.5 if g <= 30 else 10 + g / 2 if g <= 60 else 16 + g / 2.5 if g <= 90 else 22 + g / 3
    pose = lambda r, k: ((r[8] + 3 * k) % 91 - 45, (7 * r[3] + 2 * k) % 91 - 45)
    for limits in (False, True):
        taken, used, want = {}, {}, set()
        for r in sorted(rows, key=lambda r: (-r[6], r[2])):
            fits = not limits or used.get((r[3], r[5]), 0) < 4
            for x in taken.get(r[3], []) if r[3] else []:
                a, b = sorted((r, x), key=lambda v: (v[9], v[2]))
                p, q = pose(a, a[7] // 10), pose(b, 0)
                fits = fits and a[10] + turn(r[3] == 6, abs(p[0] - q[0]) + abs(p[1] - q[1])) <= b[9]
            if fits:
                taken.setdefault(r[3], []).append(r)
                used[r[3], r[5]] = used.get((r[3], r[5]), 0) + 1
                want.add(r[2])
        df = spark.createDataFrame(rows, schema)
        if limits:
            df = df.withColumns({"gb": F.lit(0.25), "w": F.lit(1.0), "max_gb": F.lit(1.0), "max_w": F.lit(0.0)})
        got = replay.accepted_rows(df, satellite, F.struct((-F.col("priority")).alias("p"), "task_id"), limits)
        assert got.count() == 400 and {r.task_id for r in got.where("accepted").collect()} == want


def test_choices_meet_lists_of_their_satellite(spark):
    """The same first blockers as by choice, loads of a plain sum, and no choice is dealt again after it is listed."""
    t = Scenarios(spark, SF)
    rows = replay.replayed(t).where("scenario_id = 'S1997'").cache()
    got = replay.blocked_choices(t, rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.index(f"Generate {g}") for g in ("posexplode", "explode")) < plan.index("Join")  # from the top
    got = {(r.schedule_id, r.window_id, r.k): (r.first, r.load, r.step, r.satellite_id) for r in got.collect()}
    want = replay.with_blockers(replay.choices(t).where("scenario_id = 'S1997'"), rows.where("accepted"), t.satellite).collect()
    assert {k: v[0] for k, v in got.items()} == {(r.schedule_id, r.window_id, r.k): r.first for r in want}
    held = rows.where("accepted").collect()
    for (schedule, *_), (_, load, step, sat) in list(got.items())[:300]:
        assert load == sum(r.duration_s for r in held if r.schedule_id == schedule and r.satellite_id == sat and r.step < step)


def test_segments_are_swept_by_satellite(spark):
    """The same segments as from listed shortages and times, with crowded, touching and repeated windows; windows are dealt once."""
    rng = random.Random(5)
    rows = [("S", i, rng.choice([1, 2, 3]), rng.randrange(40), s := rng.choice([rng.randrange(900), rng.randrange(0, 900, 30), 5_000]), s + rng.choice([10, 30, 55, 400]), 10, rng.choice([rng.randrange(500), None])) for i in range(250)]
    schema = "scenario_id string, window_id long, satellite_id long, task_id long, start_s long, end_s long, step_s long, seed long"
    w = spark.createDataFrame(rows + rows[:5], schema)
    satellite = spark.createDataFrame([(1, "agile"), (2, "non_agile")], "satellite_id long, maneuverability string")
    want = sweeps.conflict_segments(w, conflicts.adjacent_shortages(w, satellite))
    got = sweeps.swept_segments(w.drop("window_id"), satellite)
    plain = lambda df: sorted((r.satellite_id, r.start_s, r.end_s, tuple(r.tasks), r.n_tasks, r.kind) for r in df.collect())
    assert plain(got) == plain(want) and {r[-1] for r in plain(got)} == {"Overlap", "Mixed", "Transition"}
    plan = sweeps.conflict_timeline(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Generate" not in plan


def _items(spark, rng, one, worlds=("A", "B")):
    rows = [
        (w, rng.choice([1, 2, 3, None]), (task := rng.randrange(30)), i, task % 3, rng.randrange(0, 300, 5), 10, [0] if one else sorted(rng.sample(range(4), rng.randint(0, 3))), 12)
        for w in worlds for i in range(150)
    ]
    schema = "scenario_id string, satellite_id long, task_id long, window_id long, p long, start_s long, step_s long, ks array<long>, duration_s long"
    return rows, spark.createDataFrame(rows, schema).withColumn("turn_s", F.lit(3.0))


def test_first_fits_equal_the_loop(spark):
    """Crowded satellites, tasks with several windows on one and on many, offsets on no satellite, ranks of tasks and of items."""
    for seed in (1, 2, 3):
        for rank in (("task_id",), ("p", "start_s", "window_id")):
            rows, items = _items(spark, random.Random(seed), rank != ("task_id",))
            busy, done, want = {}, set(), set()
            offers = [(r, r[5] + 10 * k, k) for r in rows for k in r[7]]
            of = lambda r: (r[2],) if rank == ("task_id",) else (r[4], r[5], r[3])
            for r, s, k in sorted(offers, key=lambda o: (*of(o[0]), o[1], o[0][3], o[2])):
                own = busy.setdefault(r[:2], []) if r[1] else []
                if (r[0], r[2]) not in done and all(s + 12 + 3 <= x or x + 12 + 3 <= s for x in own):
                    own.append(s)
                    done.add((r[0], r[2]))
                    want.add((r[0], r[1], r[2], r[3], k))
            got = firstfit.first_fits(items.withColumn("rank", F.array(*rank)).drop("p"), ["scenario_id"])
            assert {(r.scenario_id, r.satellite_id, r.task_id, r.window_id, r.k) for r in got.collect()} == want
    assert firstfit.first_fits(items.withColumn("rank", F.array("p")).drop("p").limit(0), ["scenario_id"]).count() == 0


def test_balance_streams_as_the_group_chose(spark):
    t = Scenarios(spark, SF)
    w = t.placed_window.select("scenario_id", "task_id", "priority", "duration_s", "satellite_id", "window_id", "start_s")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(grouped.balance_selection(w)) == rows(grouped.run_algorithm(w, "balance_first"))
    assert "InPandas" not in grouped.greedy_schedules(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_heuristics_never_list_candidates_or_conflicts(spark, monkeypatch):
    """What travels are windows: the items of first_fits() are as many as windows and algorithms, whatever their offsets."""
    t, seen = Scenarios(spark, SF), []
    monkeypatch.setattr(replay, "first_fits", lambda items, world: seen.append(items) or firstfit.first_fits(items, world))
    assert replay.first_fit_selections(t, ["profit_first"]).count() > 0
    windows, offsets = seen[0].count(), candidates.candidates_of(t).count()
    assert windows == seen[0].select("scenario_id", "window_id").distinct().count() and windows * 3 < offsets
