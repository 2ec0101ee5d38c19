"""Replay, static-order heuristics, running numbers and the rules that no query exercises."""

import random

import pytest
from pyspark.sql import functions as F

from orbweave.functions import exprs
from orbweave.operators import grouped, replay
from orbweave.plans.ordering import numbered, running
from orbweave.tables import Scenarios

from .conftest import SF


def test_running_sums_equal_one_window(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, x int")
    got = running(df, ["g"], {"p": F.floor(F.col("i") / 37)}, ["i"], {"s": F.col("x")})
    got = numbered(got, ["g"], {"p": F.floor(F.col("i") / 11)}, ["i"], "n").collect()
    assert len(got) == 500
    for r in got:
        before = [x for g, i, x in rows if g == r.g and i < r.i]
        assert (r.s, r.n) == (sum(before), len(before))


def _turn(m, a, b):
    g = abs(b[0] - a[0]) + abs(b[1] - a[1])
    if m != "agile":
        return 10.0
    return 11.66 if g <= 10 else 5 + g / 1.5 if g <= 30 else 10 + g / 2 if g <= 60 else 16 + g / 2.5 if g <= 90 else 22 + g / 3


def _pose(seed, sat, k):
    return (seed + 3 * k) % 91 - 45, (7 * sat + 2 * k) % 91 - 45


@pytest.mark.parametrize("algorithm", ["profit_first", "timeliness_first", "completion_first"])
def test_static_heuristics_equal_the_loop(spark, algorithm):
    t = Scenarios(spark, SF)
    got = {(r.scenario_id, r.task_id): (r.window_id, r.k) for r in replay.first_fit_selections(t, [algorithm]).collect()}
    rows = t.task_window.join(t.task, ["scenario_id", "task_id"]).join(t.satellite, "satellite_id").collect()
    tasks = {}
    for r in rows:
        last = (r.end_s - r.start_s - r.duration_s) // 10
        for k in [round(last / 2)] if r.maneuverability == "non_agile" and last >= 0 else range(last + 1):
            tasks.setdefault((r.scenario_id, r.task_id), []).append((r, r.start_s + 10 * k, k))
    order = {
        "profit_first": lambda t: (-tasks[t][0][0].priority, t[1]),
        "timeliness_first": lambda t: (min(s for _, s, _ in tasks[t]), -tasks[t][0][0].priority, t[1]),
        "completion_first": lambda t: (len(tasks[t]), t[1]),
    }[algorithm]
    busy, want = {}, {}
    for task in sorted(tasks, key=order):  # of one task the earliest end is the earliest start
        for r, start, k in sorted(tasks[task], key=lambda x: (x[1], x[0].window_id, x[2])):
            me = (start, r.task_id, start + r.duration_s, _pose(r.seed, r.satellite_id, k), _pose(r.seed, r.satellite_id, k + r.duration_s // 10))
            held = busy.setdefault((r.scenario_id, r.satellite_id), [])
            if all((lambda a, b: a[2] + _turn(r.maneuverability, a[4], b[3]) <= b[0])(*sorted((me, x), key=lambda v: v[:2])) for x in held):
                held.append(me)
                want[task] = (r.window_id, k)
                break
    assert got == want


def test_completion_by_joins_equals_the_loop(spark):
    t = Scenarios(spark, SF)
    w = t.task_window.join(t.task, ["scenario_id", "task_id"]).select("scenario_id", "task_id", "priority", "duration_s", "satellite_id", "window_id", "start_s")
    rows = lambda df: sorted((r.scenario_id, r.window_id) for r in df.collect())
    assert rows(grouped.completion_selection(w)) == rows(grouped.run_algorithm(w, "completion_first"))


def test_rules_of_names_and_sensors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    name = lambda s: one(exprs.schedule_name(F.lit(s)))
    n = name("scheduler_S_c1_mip_p1_c0.5_t0_b0")
    assert (n.solver, n.class_id, n.objective, n.weights) == ("mip", 1, "p1_c0.5_t0_b0", [1.0, 0.5, 0.0, 0.0])
    n = name("scheduler_S_c2_balance_first_implicit")
    assert (n.solver, n.class_id, n.weights) == ("balance_first", 2, [0.0, 0.0, 0.0, 1.0])
    n = name("scheduler_S_c4_ppo_ppo_model_p1_c0_t0_b0")
    assert (n.solver, n.class_id, n.objective, n.weights[0]) == ("ppo", 4, "p1_c0_t0_b0", 1.0)
    assert name("anything").class_id == -1
    sensors = lambda *m: F.array(*[F.struct(F.lit(x).alias("mode"), F.lit(i).alias("i")) for i, x in enumerate(m)])
    assert one(exprs.default_sensor(sensors("SAR", "VISIBLE"))).i == 1 and one(exprs.default_sensor(sensors("SAR", "IR"))).i == 0
    assert one(exprs.scale_of(F.lit("Sats20"))).satellites == 20
    assert one(exprs.path_template(F.lit("a\\B//x_p12_cities_03.json"))) == "a/b/x_p_cities_.json"
    assert one(exprs.size_class(F.lit(3), F.lit(20), F.lit(3))) == "basic" and one(exprs.size_class(F.lit(4), F.lit(20), F.lit(3))) == "other"
