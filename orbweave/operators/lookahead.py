"""Values of forced actions over a horizon: each feasible action of each replayed state is forced, the next steps go on
greedily, and the gain in the objective is the action's value (L06).

A branch is what it adds to the state it starts from: a short list of assignments. All branches of all states go ahead
together, one round of joins for each further step: choices of the next task that fit to what the state had accepted, and
then to the branch's own additions, are scored, and the best one is added. No schedule is copied or replayed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from orbweave.functions.exprs import action_key, attitude_change, transition_s
from orbweave.operators.book import _fmod_pose, states_of, task_book, with_lacking
from orbweave.operators.objective import WEIGHTS, lacking_at, loads_before, normalised, replay_steps, scenario_totals, score, with_states
from orbweave.operators.replay import blocked_choices, replayed
from orbweave.operators.schedules import KEY
from orbweave.operators.stations import _turns
from orbweave.operators.trajectories import PART_STEPS
from orbweave.session import new_path, written
from orbweave.tables import HORIZON_S, STEP_S, Scenarios

#: Forced actions with choices of the next step that are compared at a time.
PAIRS_AT_ONCE = 300_000
_STATE = ("profit0", "n0", "early0", "busy0", "below0", "low0", "possible", "tasks", "required_s", "sats", "base_0", "base_1", "base_2")
ADDITION = "array<struct<satellite_id:bigint,task_id:bigint,s:bigint,e:bigint,r0:bigint,p0:bigint,r1:bigint,p1:bigint,load:bigint>>"


def _clash(x: Column) -> Column:
    """Whether the choice of the row does not fit to an addition x of its branch."""
    agile = F.col("maneuverability") == "agile"
    ahead = transition_s(attitude_change([F.col("roll1"), F.col("pitch1")], [x["r0"], x["p0"]]), agile=agile)
    behind = transition_s(attitude_change([x["r1"], x["p1"]], [F.col("roll0"), F.col("pitch0")]), agile=agile)
    first = F.struct(F.col("sat_start_s").alias("s"), F.col("c_task").alias("t")) < F.struct(x["s"].alias("s"), x["task_id"].alias("t"))
    return (x["satellite_id"] == F.col("satellite_id")) & F.when(first, F.col("sat_end_s") + ahead > x["s"]).otherwise(x["e"] + behind > F.col("sat_start_s"))


def _lacking(adds: Column) -> Column:
    """What loads lack to the mean with a branch's additions, times the satellites: base, put right for each satellite that
    has additions."""
    mean = F.col("busy0") + F.col("extra")

    def change(acc: Column, s: Column) -> Column:
        own = F.filter(adds, lambda y: y["satellite_id"] == s)
        gap = mean - F.col("sats") * F.get(own, 0)["load"]
        more = F.aggregate(own, F.lit(0).cast("long"), lambda t, y: t + y["e"] - y["s"])
        return acc - F.greatest(gap, F.lit(0)) + F.greatest(gap - F.col("sats") * more, F.lit(0))

    return F.aggregate(F.array_distinct(F.transform(adds, lambda y: y["satellite_id"])), F.col("base").cast("long"), change)


def _extended(branches: DataFrame, states: DataFrame, blocked: DataFrame, lag: int, weights: tuple[float, ...]) -> DataFrame:
    """Each branch with each choice that fits to it lag steps after its state, not the skip: adds, extra, profit, n, early
    and now (the objective) as they would become, and key."""
    us = lambda c: F.col(c) * 1_000_000
    key = action_key(F.col("c_task"), F.col("satellite_id"), F.lit("main"), F.col("orbit_number"), F.col("window_id"), us("sat_start_s"), us("sat_end_s"))
    c = loads_before(states, blocked.where(F.col("first").isNull() | (F.col("first") >= F.col("step") - lag)), lag)
    c = c.withColumn("step", F.col("step") - lag).where("step >= 0").withColumnsRenamed({"task_id": "c_task", "priority": "c_priority"})
    rows = branches.join(c, [*KEY, "step"]).where(~F.exists("adds", _clash))
    new = F.struct(
        F.col("satellite_id").cast("long"), F.col("c_task").cast("long").alias("task_id"), F.col("sat_start_s").alias("s"), F.col("sat_end_s").alias("e"),
        *[F.col(c).cast("long").alias(n) for c, n in (("roll0", "r0"), ("pitch0", "p0"), ("roll1", "r1"), ("pitch1", "p1"), ("load", "load"))],
    )
    rows = rows.select(
        *KEY, "step", "action", key.alias("key"), F.concat("adds", F.array(new).cast(ADDITION)).alias("adds"), (F.col("extra") + F.col("duration_s")).alias("extra"),
        (F.col("profit") + F.col("c_priority")).alias("profit"), (F.col("n") + 1).alias("n"), (F.col("early") + HORIZON_S - F.col("sat_start_s")).alias("early"),
    )
    rows = rows.join(lacking_at(states, rows.select(*KEY, "step", "extra").distinct()), [*KEY, "step", "extra"])
    rows = rows.join(states.select(*KEY, "step", "profit0", "n0", "early0", "busy0", "possible", "tasks", "required_s", "sats"), [*KEY, "step"])
    now = score(weights, F.col("profit0") + F.col("profit"), F.col("n0") + F.col("n"), F.col("early0") + F.col("early"), _lacking(F.col("adds")))
    return rows.select(*KEY, "step", "action", "key", "adds", "extra", "profit", "n", "early", now.alias("now"))


def action_values(states: DataFrame, blocked: DataFrame, horizon: int, weights: tuple[float, ...]) -> DataFrame:
    """KEY, step, action, taken, value: for each feasible action of each state, and the skip, the objective after horizon
    decisions less that of the state; taken: assignments among them. Ties of the greedy steps go by action key, and a step
    is skipped if every choice lowers the objective. Fewer decisions where the tasks end.

    states: with_states(), blocked: with_blockers(), both as tables.
    """
    from orbweave.operators.objective import _before

    spark = states.sparkSession
    none = F.lit(0).cast("long")
    start = states.select(
        *KEY, "step", F.concat(F.lit("skip|"), F.col("task_id").cast("string")).alias("action"), F.array().cast(ADDITION).alias("adds"),
        none.alias("extra"), none.alias("profit"), none.alias("n"), none.alias("early"), _before(weights).alias("now"),
    )
    forced = _extended(start, states, blocked, 0, weights).withColumn("action", F.col("key")).drop("key")
    branches = written(start.unionByName(forced), new_path(spark, "branches"))
    for lag in range(1, horizon):
        better = _extended(branches, states, blocked, lag, weights)
        worth = F.struct(F.round(-F.col("now"), 12).alias("loss"), F.col("key"))
        rest = [c for c in better.columns if c not in (*KEY, "step", "action")]
        best = better.groupBy(*KEY, "step", "action").agg(F.min_by(F.struct(*rest), worth).alias("b"))
        rows = branches.join(best, [*KEY, "step", "action"], "left")
        go = F.col("b").isNotNull() & (F.round(F.col("b.now"), 12) >= F.round(F.col("now"), 12))
        fields = ("adds", "extra", "profit", "n", "early", "now")
        branches = written(rows.select(*KEY, "step", "action", *[F.when(go, F.col(f"b.{c}")).otherwise(F.col(c)).alias(c) for c in fields]), new_path(spark, "branches"))
    base = states.select(*KEY, "step", _before(weights).alias("score0"))
    return branches.join(base, [*KEY, "step"]).select(*KEY, "step", "action", F.col("n").alias("taken"), (F.col("now") - F.col("score0")).alias("value"))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] places each, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _objective(w: tuple[float, ...], s: dict, at: np.ndarray, profit, n, early, lacking) -> np.ndarray:
    """score() of states at."""
    timely = np.maximum(early / (s["tasks"][at] * HORIZON_S), 0.0)
    balance = np.maximum(1 - lacking / (s["sats"][at] * s["required_s"][at]), 0.0)
    return w[0] * profit / s["possible"][at] + w[1] * n / s["tasks"][at] + w[2] * timely + w[3] * balance


def _put_right(base, busy, extra, sats, load, more):
    """What loads lack to the mean, with one satellite's own load put right."""
    gap = busy + extra - sats * load
    return base - np.maximum(gap, 0) + np.maximum(gap - sats * more, 0)


def _pair_values(s: dict, c: dict, w: tuple[float, ...]) -> dict[str, np.ndarray]:
    """Of states in order of steps, with next (whether the row behind is the next step of the schedule), and their choices c
    (state, k, ..., gap, load0: before the own step, load1: before the step before): a row for each forced action."""
    size = len(s["step"])
    forced = np.flatnonzero(c["gap"][:-1] == 0)  # the last row stands for none
    of = np.concatenate((np.arange(size), c["state"][forced]))  # the skip of each state, then its choices
    choice = np.concatenate((np.full(size, -1), forced))
    does = choice >= 0
    busy, sats = s["busy0"][of], s["sats"][of]
    start, load = np.where(does, c["start"][choice], 0), np.where(does, c["load0"][choice], 0)
    lasts = np.where(does, s["duration_s"][of], 0)
    profit, n, early = s["profit0"][of] + np.where(does, s["priority"][of], 0), s["n0"][of] + does, s["early0"][of] + np.where(does, HORIZON_S - start, 0)
    before = s["below0"][of] * busy - sats * s["low0"][of]
    lacking = np.where(does, _put_right(s["base_0"][of], busy, lasts, sats, load, lasts), before)
    value0 = _objective(w, s, of, s["profit0"][of], s["n0"][of], s["early0"][of], before)
    now = np.where(does, _objective(w, s, of, profit, n, early, lacking), value0)
    # choices of the next step, those that fit to what was accepted before this one
    first, many = np.searchsorted(c["state"], np.arange(size), "left"), np.bincount(c["state"][:-1], minlength=size)
    ahead = np.where(s["next"][of], many[np.minimum(of + 1, size - 1)], 0)
    best, taken = np.full(len(of), -np.inf), does.astype(np.int64)
    ends, at = np.cumsum(ahead), 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        b = np.repeat(np.arange(at, to), ahead[at:to])
        d = _spread(first[np.minimum(of[at:to] + 1, size - 1)], ahead[at:to])
        x, o = choice[b], of[b]
        both = x >= 0
        on = both & (c["satellite"][d] == c["satellite"][x]) & c["somewhere"][d]
        s0, s1, t0, t1 = start[b], c["start"][d], s["task_id"][o], s["task_id"][o + 1]
        e0, e1 = s0 + lasts[b], s1 + s["duration_s"][o + 1]
        later = (s1 < s0) | (s1 == s0) & (t1 < t0)  # the next choice comes first
        turn = lambda p, q: _turns(c["agile"][d], abs(c["roll1"][p] - c["roll0"][q]) + abs(c["pitch1"][p] - c["pitch0"][q]))
        clash = on & np.where(later, e1 + turn(d, x) > s0, e0 + turn(x, d) > s1)
        keep = np.flatnonzero(~clash)
        b, d, x, o, on = b[keep], d[keep], x[keep], o[keep], on[keep]
        more = s["duration_s"][o + 1]
        extra = lasts[b] + more
        base = np.where(x >= 0, s["base_2"][o], s["base_1"][o])
        sats_o, busy_o = s["sats"][o], s["busy0"][o]
        alone = _put_right(base, busy_o, extra, sats_o, c["load1"][d], np.where(on, extra, more))
        lack = np.where((x >= 0) & ~on, _put_right(alone, busy_o, extra, sats_o, load[b], lasts[b]), alone)
        then = _objective(w, s, o, profit[b] + s["priority"][o + 1], n[b] + 1, early[b] + HORIZON_S - c["start"][d], lack)
        np.maximum.at(best, b, then)
        at = to
    go = np.round(best, 12) >= np.round(now, 12)
    return {"state": of, "choice": choice, "taken": taken + go, "value": np.where(go, best, now) - value0}


def _valued_batches(batches, weights: tuple[float, ...], schema: pa.Schema):
    """Batches of whole parts, in order of steps."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, rows]) if held else rows
        if not len(held):
            continue
        last = pc.and_(pc.and_(pc.equal(held["scenario_id"], held["scenario_id"][-1]), pc.equal(held["schedule_id"], held["schedule_id"][-1])), pc.equal(held["piece"], held["piece"][-1]))
        whole = len(held) - pc.sum(last).as_py()
        if whole:
            yield from _valued(held.slice(0, whole), weights, schema)
            held = held.slice(whole)
    if held:
        yield from _valued(held, weights, schema)


def _valued(rows: pa.Table, weights: tuple[float, ...], schema: pa.Schema):
    rows = rows.combine_chunks()
    column = lambda n: rows.column(n).combine_chunks() if isinstance(rows.column(n), pa.ChunkedArray) else rows.column(n)
    s = {n: pc.fill_null(column(n), 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("step", "piece", "task_id", "priority", "duration_s", *_STATE)}
    runs = [column(n).dictionary_encode().indices.to_numpy(zero_copy_only=False) for n in KEY]
    same = (runs[0][1:] == runs[0][:-1]) & (runs[1][1:] == runs[1][:-1]) & (s["piece"][1:] == s["piece"][:-1]) & (s["step"][1:] == s["step"][:-1] + 1)
    s["next"] = np.r_[same, False]
    windows = column("windows")
    of_window = np.repeat(np.arange(len(windows)), pc.fill_null(pc.list_value_length(windows), 0).to_numpy(zero_copy_only=False))
    w = windows.flatten()
    field = lambda n: pc.struct_field(w, n)
    fit = field("fit")
    size = pc.list_value_length(fit).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(w)), size)
    code = fit.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    end = lambda v, last=0: np.append(v, np.array([last], v.dtype))
    number = lambda n: end(pc.fill_null(field(n), 0).to_numpy(zero_copy_only=False).astype(np.int64)[of])
    c = {"state": end(of_window[of], len(windows)), "k": end(code // 2), "gap": end(code % 2), "satellite": number("satellite_id")}
    c["somewhere"] = end(pc.is_valid(field("satellite_id")).to_numpy(zero_copy_only=False)[of])
    c |= {"load0": number("load0"), "load1": number("load1"), "agile": end(field("agile").to_numpy(zero_copy_only=False).astype(bool)[of]), "start": number("start_s") + c["k"] * STEP_S}
    lasts = end(s["duration_s"])[c["state"]] // STEP_S
    c["roll0"], c["pitch0"] = _fmod_pose(number("seed"), c["satellite"], c["k"])
    c["roll1"], c["pitch1"] = _fmod_pose(number("seed"), c["satellite"], c["k"] + lasts)
    got = _pair_values(s, c, normalised(weights))
    own = np.flatnonzero(s["step"][got["state"]] // PART_STEPS == s["piece"][got["state"]])
    state, choice = got["state"][own], got["choice"][own]
    skip = choice < 0
    pick = lambda v: pa.array(v[choice], mask=skip)
    known = {
        "satellite_id": pa.array(c["satellite"][choice], mask=skip | ~c["somewhere"][choice]), "orbit_number": pick(number("orbit_number")), "window_id": pick(number("window_id")), "sat_start_s": pick(c["start"]),
        "step": pa.array(s["step"][state]), "task_id": pa.array(s["task_id"][state]), "duration_s": pa.array(s["duration_s"][state]), "taken": pa.array(got["taken"][own]), "value": pa.array(got["value"][own]),
        **{n: column(n).take(pa.array(state)) for n in KEY},
    }
    for a in range(0, len(state), 50_000):
        yield pa.RecordBatch.from_arrays([known[f.name].slice(a, 50_000).cast(f.type) for f in schema], schema=schema)


def next_values(t: Scenarios, weights: tuple[float, ...]) -> DataFrame:
    """action_values() of all states at a horizon of two, with step, task_id and the columns of the action's key (window_id is null
    for the skip).

    Steps are dealt with their windows by parts of PART_STEPS, each with the first step of the next part. Forced actions and
    the choices of the next step meet there in numpy, in blocks, and are never rows.
    """
    states = states_of(t, task_book(t, "choices", 2))
    own = F.floor(F.col("step") / PART_STEPS).cast("int")
    shown = F.when((own > 0) & (F.col("step") % PART_STEPS == 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = states.withColumn("piece", F.explode(shown)).withColumn("own", F.col("piece") == own)
    rows = rows.withColumn("next_s", F.lead("duration_s").over(Window.partitionBy(*KEY, "piece").orderBy("step")))
    rows = with_lacking(rows.withColumn("both_s", F.col("duration_s") + F.col("next_s")), ["duration_s", "next_s", "both_s"], states)
    x = lambda w: F.get(w["by"], F.col("run"))
    names = ("satellite_id", "orbit_number", "window_id", "start_s", "seed", "agile")
    windows = F.transform(
        F.filter("windows", lambda w: F.size(x(w)["fit"]) > 0),
        lambda w: F.struct(*[w[n].alias(n) for n in names], x(w)["fit"].alias("fit"), F.get(x(w)["load"], F.lit(0)).alias("load0"), F.get(x(w)["load"], F.lit(1)).alias("load1")),
    )
    rows = rows.select(*KEY, "step", "piece", "task_id", "priority", "duration_s", *_STATE, windows.alias("windows"))
    schema = T._parse_datatype_string(
        "scenario_id string, schedule_id string, step long, task_id long, duration_s long, satellite_id long, orbit_number long, window_id long, sat_start_s long, taken long, value double"
    )
    arrow = to_arrow_schema(schema)
    rows = rows.repartition(*KEY, "piece").sortWithinPartitions(*KEY, "piece", "step")
    return rows.mapInArrow(lambda b: _valued_batches(b, weights, arrow), schema)


def branch_values(t: Scenarios, horizon: int) -> DataFrame:
    """action_values() of all states at any horizon, with all choices as rows."""
    rows = written(replayed(t), new_path(t.spark, "replayed"))
    states = written(with_states(replay_steps(rows, t.task), scenario_totals(t.task, t.satellite)), new_path(t.spark, "states"))
    blocked = written(blocked_choices(t, rows).drop("load"), new_path(t.spark, "blocked"))
    values = action_values(states, blocked, horizon, WEIGHTS["mixed"])
    return values.select(*KEY, F.col("step").cast("int").alias("step"), "action", "taken", F.round(F.col("value") * 1e6, 3).alias("value_ppm"))


def horizon_values(spark, sf_dir: str, horizon: int = 2) -> DataFrame:
    """Values of all actions of all replayed states at a horizon of two, in millionths of the objective."""
    if horizon != 2:
        return branch_values(Scenarios(spark, sf_dir), horizon)
    v = next_values(Scenarios(spark, sf_dir), WEIGHTS["mixed"])
    us = lambda c: c * 1_000_000
    end = F.col("sat_start_s") + F.col("duration_s")
    action = action_key(F.col("task_id"), F.col("satellite_id"), F.lit("main"), F.col("orbit_number"), F.col("window_id"), us(F.col("sat_start_s")), us(end))
    return v.select(*KEY, F.col("step").cast("int").alias("step"), action.alias("action"), "taken", F.round(F.col("value") * 1e6, 3).alias("value_ppm"))


QUERIES = {"horizon_values": (horizon_values, None)}
