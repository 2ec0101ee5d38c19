"""Values of forced actions, their objective and feasibility against a loop over one schedule."""

import pytest
from pyspark.sql import functions as F

from orbweave.operators import lookahead, objective, replay
from orbweave.session import new_path, written
from orbweave.tables import Scenarios

from .conftest import SF
from .test_replay import _turn

SCENARIO, SCHEDULE = "S1997", "longest"


@pytest.fixture(scope="module")
def inputs(spark):
    t = Scenarios(spark, SF)
    mine = (F.col("scenario_id") == SCENARIO) & (F.col("schedule_id") == SCHEDULE)
    rows = written(replay.replayed(t).where(mine), new_path(spark, "rows"))
    task = t.task.where(F.col("scenario_id") == SCENARIO)
    states = written(objective.with_states(objective.replay_steps(rows, task), objective.scenario_totals(task, t.satellite)), new_path(spark, "states"))
    blocked = written(replay.with_blockers(replay.choices(t).where(mine), rows.where("accepted"), t.satellite), new_path(spark, "blocked"))
    return rows, states, blocked, t


def _objective(weights, done, total, tasks, required, sats):
    w = objective.normalised(weights)
    loads = dict.fromkeys(sats, 0)
    for c in done:
        loads[c.satellite_id] += c.sat_end_s - c.sat_start_s
    mean = sum(loads.values()) / len(loads)
    timely = max(0.0, sum(3600 - c.sat_start_s for c in done) / (tasks * 3600))
    balance = max(0.0, 1 - sum(abs(x - mean) for x in loads.values()) / (2 * required))
    return w[0] * sum(c.priority for c in done) / total + w[1] * len(done) / tasks + w[2] * timely + w[3] * balance


def _fits(c, done):
    for x in done:
        if x.satellite_id == c.satellite_id:
            a, b = sorted((c, x), key=lambda r: (r.sat_start_s, r.task_id))
            if a.sat_end_s + _turn(c.maneuverability, (a.roll1, a.pitch1), (b.roll0, b.pitch0)) > b.sat_start_s:
                return False
    return True


def _key(c):
    return f"assign|{c.task_id}|{c.satellite_id}|main|{c.orbit_number}|{c.window_id}|{c.sat_start_s * 1000000}|{c.sat_end_s * 1000000}"


@pytest.mark.parametrize("horizon, weights", [(1, (0.4, 0.3, 0.2, 0.1)), (3, (0.1, 0.0, 0.1, 0.8))])
def test_values_equal_the_loop(inputs, horizon, weights):
    rows, states, blocked, t = inputs
    got = {(r.step, r.action): (r.taken, r.value) for r in lookahead.action_values(states, blocked, horizon, weights).collect()}
    steps = {r.step: r for r in states.collect()}
    by_step = {}
    for c in blocked.collect():
        by_step.setdefault(c.step, []).append(c)
    accepted = {(r.task_id, r.window_id, r.sat_start_s) for r in rows.where("accepted").collect()}
    poses = {(c.task_id, c.window_id, c.sat_start_s): c for own in by_step.values() for c in own}
    from orbweave.operators.schedules import posed

    done_at = {r.task_id: r for r in posed(rows.where("accepted"), t.satellite).collect()}
    sats = [r.satellite_id for r in t.satellite.collect()]
    tasks, total = len(steps), sum(s.priority for s in steps.values())
    required = sum(s.duration_s for s in steps.values())
    assert poses and accepted
    value = lambda done: _objective(weights, done, total, tasks, required, sats)
    seen = 0
    for step in range(0, tasks, 23):
        before = [done_at[steps[s].task_id] for s in range(step) if steps[s].task_id in done_at]
        base = value(before)
        for forced in [None, *[c for c in by_step.get(step, []) if _fits(c, before)]]:
            done = before + ([forced] if forced else [])
            for ahead in range(step + 1, min(tasks, step + horizon)):
                options = [(-round(value(done), 12), "skip|", None)] + [(-round(value(done + [c]), 12), _key(c), c) for c in by_step.get(ahead, []) if _fits(c, done)]
                best = min(options, key=lambda o: o[:2])[2]
                done = done + ([best] if best else [])
            action = _key(forced) if forced else f"skip|{steps[step].task_id}"
            taken, worth = got[(step, action)]
            assert taken == len(done) - len(before) and abs(worth - (value(done) - base)) < 1e-9, (step, action)
            seen += 1
        assert sum(k[0] == step for k in got) == 1 + sum(_fits(c, before) for c in by_step.get(step, []))
    assert seen > 60


def test_weights_are_checked():
    assert objective.normalised((0, 0, 0, 0)) == (1.0, 0.0, 0.0, 0.0) and objective.normalised((2, 1, 1, 0)) == (0.5, 0.25, 0.25, 0.0)
    for bad in ((1, 2, 3), (1, -1, 0, 0), (1, None, 0, 0), (float("nan"), 0, 0, 0)):
        with pytest.raises(ValueError):
            objective.normalised(bad)
