"""Small fixtures with known results, brute force, and invariance under input order."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbweave.functions import exprs
from orbweave.operators import catalogs, grouped, schedules, sweeps, trajectories
from orbweave.operators.candidates import enumerate_candidates, place
from orbweave.plans.range_join import follows_within
from orbweave.sources import files
from orbweave.tables import Scenarios


def test_quantiles_are_linear_between_ranks(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3)], "q double")
    p = df.select(F.percentile("q", F.array(*[F.lit(x) for x in (0.0, 0.1, 0.5, 0.9, 1.0)]))).first()[0]
    assert [round(x, 9) for x in p] == [1, 1.4, 3, 4.6, 5]


def test_transition_pieces(spark):
    df = spark.createDataFrame([(10.0,), (30.0,), (60.0,), (90.0,), (91.0,), (None,)], "g double")
    got = [round(r[0], 4) for r in df.select(exprs.transition_s(F.col("g"))).collect()]
    assert got == [11.66, 25.0, 40.0, 52.0, 52.3333, 11.66]


def test_profile_names(spark):
    df = spark.createDataFrame([("high",), ("Low_Agility",), ("what",)], "n string")
    assert [r[0] for r in df.select(exprs.profile_name(F.col("n"))).collect()] == ["High-Agility", "Low-Agility", "Standard-Agility"]


def test_round_trip_hex(spark):
    df = spark.createDataFrame([(0.1,), (None,), (-2.5,)], "x double")
    got = [r[0] for r in df.select(exprs.round_trip_hex(F.col("x"))).collect()]
    assert got == [(0.1).hex(), None, (-2.5).hex()]


def test_epochs_in_several_forms(spark):
    df = spark.createDataFrame([("18 Nov 2025 12:00:00.000",), ("1763467200",), ("2025-11-18T12:00:00Z",), ("nonsense",)], "t string")
    got = [r[0] for r in df.select(F.unix_timestamp(exprs.any_epoch(F.col("t")))).collect()]
    assert got == [1763467200, 1763467200, 1763467200, None]


def test_placement_that_does_not_fit_is_null(spark):
    df = spark.createDataFrame([(0, 10, 4), (0, 3, 4)], "s long, e long, d long")
    got = df.select(*[place(F.col("s"), F.col("e"), F.col("d"), m) for m in ("earliest", "center", "latest", "odd")]).collect()
    assert [tuple(r) for r in got] == [(0, 3, 6, 0), (None,) * 4]


def test_candidate_order_does_not_depend_on_input_order(spark):
    windows = pd.DataFrame(
        [("s", 10, 1, 7, 1, 0, 20, 5, 3, "A"), ("s", 20, 1, 7, 1, 0, 20, 5, 3, "A"), ("s", 30, 1, 7, 1, 40, 60, 5, 3, "A")],
        columns=["scenario_id", "window_id", "satellite_id", "task_id", "orbit_number", "start_s", "end_s", "step_s", "seed", "flag"],
    )
    task = spark.createDataFrame([("s", 7, 1, 5)], "scenario_id string, task_id long, priority long, duration_s long")
    satellite = spark.createDataFrame([(1, "agile", 1.0, 1.0)], "satellite_id long, maneuverability string, data_rate_mbps double, power_w double")

    def run(pdf, cap):
        c = enumerate_candidates(spark.createDataFrame(pdf), task, satellite, cap)
        return [(r.window_id, r.k) for r in c.orderBy("place_rank").collect()]

    full = run(windows, None)
    assert len(full) == 12 and full[:3] == [(10, 0), (10, 2), (10, 3)]
    assert run(windows.iloc[::-1], None) == full
    assert run(windows, 5) == full[:5]


def test_merge_takes_touching_intervals_together(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("a", 1, 2)], "k string, start_s long, end_s long")
    got = sorted((r.start_s, r.end_s) for r in sweeps.merge_intervals(df, ["k"]).collect())
    assert got == [(0, 7), (9, 10)]


def test_ends_come_before_starts_at_equal_times(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7)], "k string, start_s long, end_s long")
    got = [(r.at_s, r.until_s, r.active) for r in sweeps.active_counts(df, ["k"]).orderBy("at_s").collect()]
    assert got == [(0, 5, 1), (5, 7, 1)]


def test_two_windows_of_one_task_are_no_conflict(spark):
    w = spark.createDataFrame([("s", 1, 7, 0, 10), ("s", 1, 7, 5, 12)], "scenario_id string, satellite_id long, task_id long, start_s long, end_s long")
    none = spark.createDataFrame([], "scenario_id string, satellite_id long, task_id long, r_task_id long, end_s long, r_at_s long")
    assert sweeps.conflict_segments(w, none).count() == 0


def test_range_join_equals_the_nested_loop(spark):
    left = spark.createDataFrame([(i % 3, (i * 37) % 200) for i in range(60)], "k int, at long")
    right = spark.createDataFrame([(i % 3, (i * 53) % 200, i) for i in range(60)], "k int, at long, id int")
    got = follows_within(left, right, ["k"], "at", F.lit(25), 25).count()
    want = left.alias("l").join(right.alias("r"), F.expr("l.k = r.k AND r.at >= l.at AND r.at < l.at + 25")).count()
    assert got == want


def test_an_idle_satellite_lowers_the_balance(spark):
    a = spark.createDataFrame(
        [("s", "x", 1, 1, 1, 1, 5, 5, 0, 0, 5)],
        "scenario_id string, schedule_id string, task_id long, satellite_id long, window_id long, orbit_number long, priority long, duration_s long, seed long, sat_start_s long, sat_end_s long",
    )
    task = spark.createDataFrame([("s", 1, 5, 5)], "scenario_id string, task_id long, priority long, duration_s long")
    balance = lambda n: schedules.schedule_metrics(a, task, spark.range(1, n + 1).withColumnRenamed("id", "satellite_id")).first()["balance"]
    assert balance(1) == 1.0 and balance(2) == 0.5


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_equals_the_loop(spark, seed):
    import random

    rng = random.Random(seed)
    n = 40
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.12} | {(i, i + 1) for i in range(6)}
    taken = []
    for i in range(n):
        if not any((min(i, j), max(i, j)) in edges for j in taken):
            taken.append(i)
    items = spark.createDataFrame([(i, i) for i in range(n)], "id int, rank int")
    got = trajectories.select_without_conflicts(items, spark.createDataFrame(sorted(edges), "a int, b int"))
    assert sorted(r.id for r in got.collect()) == taken


def test_gains_add_up_to_the_profit(spark):
    t = Scenarios(spark, "/root/testdata/sf0.001")
    gains = trajectories.steps(t.assignment, t.task).groupBy("scenario_id", "schedule_id").agg(F.sum("delta").alias("g"))
    profit = schedules.schedule_metrics(t.assignment, t.task, t.satellite).select("scenario_id", "schedule_id", "profit")
    assert gains.join(profit, ["scenario_id", "schedule_id"]).where("g <> profit").count() == 0


def test_selection_without_overlaps_is_feasible(spark):
    t = Scenarios(spark, "/root/testdata/sf0.001")
    got = trajectories.conflict_free_windows(t.task_window.where("scenario_id = 'S2001'"), t.task).select(F.split("id", "/")[1].cast("long").alias("window_id"))
    w = t.task_window.where("scenario_id = 'S2001'").join(got, "window_id")
    pdf = w.toPandas().sort_values(["satellite_id", "start_s"])
    assert not pdf["task_id"].duplicated().any()
    for _, own in pdf.groupby("satellite_id"):
        assert (own["start_s"].to_numpy()[1:] >= own["end_s"].cummax().to_numpy()[:-1]).all()


def test_every_scenario_is_selected_as_by_the_loop(spark):
    t = Scenarios(spark, "/root/testdata/sf0.001")
    w = t.task_window.join(t.task, ["scenario_id", "task_id"]).toPandas()
    want, busy, done = set(), {}, set()
    for r in w.sort_values(["priority", "start_s", "window_id"], ascending=[False, True, True]).itertuples():
        own = busy.setdefault((r.scenario_id, r.satellite_id), [])
        if (r.scenario_id, r.task_id) not in done and all(r.end_s <= s or e <= r.start_s for s, e in own):
            own.append((r.start_s, r.end_s))
            done.add((r.scenario_id, r.task_id))
            want.add(f"{r.scenario_id}/{r.window_id}")
    query, sql = trajectories.QUERIES["conflict_free_selection"]
    got = [r.id for r in query(spark, "/root/testdata/sf0.001").collect()]
    assert sql is None and len(got) == len(want) and set(got) == want
    assert {i.split("/")[0] for i in got} == set(w["scenario_id"]) and w["scenario_id"].nunique() == 7


def test_rounds_run_until_nothing_is_open(spark):
    items = spark.createDataFrame([(i, i) for i in range(130)], "id int, rank int")
    chain = spark.createDataFrame([(i, i + 1) for i in range(129)], "a int, b int")
    got = trajectories.select_without_conflicts(items, chain)
    assert sorted(r.id for r in got.collect()) == list(range(0, 130, 2))


def test_quotas_give_the_remainder_to_the_first(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert [r.quota for r in catalogs.balanced_quotas(c, "k", 8).orderBy("k").collect()] == [3, 3, 2]


def test_stateful_heuristics_are_feasible():
    w = pd.DataFrame({"scenario_id": "s", "task_id": [1, 1, 2, 3], "priority": [1, 1, 5, 3], "duration_s": 5, "satellite_id": [1, 2, 1, 1], "window_id": [1, 2, 3, 4], "start_s": [0, 0, 0, 3]})
    for f in grouped.ALGORITHMS.values():
        got = f(w)
        assert not got["task_id"].duplicated().any() and len(got) == 2


def test_stratified_states_equal_the_greedy_on_all_states(spark):
    sf = "/root/testdata/sf0.001"
    line = pd.read_parquet(f"{sf}/lineitem.parquet")
    n = line.drop_duplicates(["l_orderkey", "l_partkey", "l_suppkey"]).groupby("l_orderkey").size()
    returned = set(line[line["l_returnflag"] == "R"]["l_orderkey"])
    pools = {}
    for r in catalogs.states(Scenarios(spark, sf)).collect():
        if n.get(r.state_id, 0) >= 2:
            pools.setdefault(r.instance, []).append((n[r.state_id], r.state_hash, r.state_id, r.family, r.step // 10, "assign" if r.state_id in returned else "skip"))
    want = set()
    for instance, pool in pools.items():
        rows = [(h, i, c, (f, p, k * 4 // len(pool), kind)) for k, (c, h, i, f, p, kind) in enumerate(sorted(pool))]
        families = sorted({x[3] for x in pool})
        goal = [{f: 20 // len(families) + (k < 20 % len(families)) for k, f in enumerate(families)}, dict.fromkeys(range(4), 5), dict.fromkeys(range(4), 5), {"assign": 20, "skip": 0}]
        have, chosen = [dict.fromkeys(g, 0) for g in goal], []
        for _ in range(20):
            def score(row):
                return sum(w * ((h[v] + 1 - g[v]) ** 2 - (h[v] - g[v]) ** 2) for w, h, g, v in zip((1, 1, 1, 0.75), have, goal, row[3])), row[0]

            weak, short = sum(c < 4 for _, _, c, _ in chosen), sum(c < 5 for _, _, c, _ in chosen)
            best = min((r for r in rows if r not in chosen and (r[2] >= 4 or weak < 10) and (r[2] >= 5 or short < 15)), key=score)
            chosen.append(best)
            for h, v in zip(have, best[3]):
                h[v] += 1
        want |= {(instance, r[1]) for r in chosen}
    got = grouped.stratified_states(spark, sf).collect()
    assert len(got) == 7 * 20 and {(r.instance, r.state_id) for r in got} == want


def test_floors_hold_back_rows_without_the_flag():
    pdf = pd.DataFrame({"state_hash": list("abcd"), "phase": [0, 0, 1, 1], "signal": [False, False, True, True]})
    got = grouped.marginal_selection(pdf, 2, {"phase": {0: 2, 1: 0}}, {"signal": 1})
    assert got["state_hash"].tolist() == ["a", "c"]
    with pytest.raises(ValueError):
        grouped.marginal_selection(pdf, 3, {"phase": {0: 2, 1: 1}}, {"signal": 3})


SCENARIO = {
    "scenario_id": "one", "metadata": {"creation_time": "2025-01-01T00:00:00Z", "duration": 3600.0, "time_step": 1.0},
    "satellites": [{"id": "A", "maneuverability_type": "Non-Agile", "satellite_specs": {"max_power_W": 5.0}, "observation_capability": {"sensors": [{"sensor_id": "x", "data_rate_Mbps": 2.0}]}}],
    "ground_stations": [{"id": "G"}], "missions": [{"id": "M1", "priority": 3.0, "observation_requirement": {"duration_s": 5.0}}],
    "observation_windows": [
        {"satellite_id": "A", "mission_id": "M1", "sensor_id": "x", "time_windows": [
            {"start_time": "2025-01-01T00:00:10Z", "end_time": "2025-01-01T00:00:30+00:00", "orbit_number": 1, "agile_data": {"pitch_angles": [1.0, 2.0], "yaw_angles": [0.0, 0.0], "roll_angles": [4.0, 5.0]}},
            {"start_time": "2025-01-01T00:00:30Z", "end_time": "2025-01-01T00:00:30Z"}]},
        {"satellite_id": "nobody", "mission_id": "M1", "time_windows": [{"start_time": "2025-01-01T00:00:10Z", "end_time": "2025-01-01T00:00:30Z"}]}],
    "communication_windows": [{"satellite_id": "A", "ground_station_id": "G", "time_windows": [{"start_time": "2025-01-01T00:01:00Z", "end_time": "2025-01-01T00:02:00Z"}]}],
}


def test_scenario_files(spark, tmp_path):
    (tmp_path / "scenario_one.json").write_text(json.dumps(SCENARIO))
    (tmp_path / "schedules").mkdir()
    (tmp_path / "schedules" / "scenario_one.json").write_text("{}")
    assert files.discover(spark, str(tmp_path)).count() == 1
    t = files.read_scenarios(spark, str(tmp_path / "scenario_one.json"))
    w = t["task_window"].collect()
    assert [(r.window_id, r.satellite_id, r.pitch0, r.roll0) for r in w] == [(1, "A", 1.0, 4.0)]
    assert t["satellite"].first().maneuverability == "non_agile" and t["satellite"].first().max_storage_gb == 0.0
    assert t["comm_window"].count() == 1
    out = json.loads(files.scenario_documents(t).first()["json"])
    assert out["missions"][0]["id"] == "M1" and len(out["observation_windows"][0]["time_windows"]) == 1
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "scenario_two.json").write_text(json.dumps(out))
    again = files.read_scenarios(spark, str(tmp_path / "again" / "scenario_two.json"))
    for name, df in t.items():  # nothing is lost but the name of the file
        assert df.drop("file").collect() == again[name].drop("file").collect(), name


def test_manoeuvrability_is_searched_in_six_places(spark, tmp_path):
    kind = lambda v: {"maneuverability_type": v}
    cases = [
        ({}, "agile"), (kind("Non-Agile"), "non_agile"), ({**kind("agile"), "maneuverability_capability": kind("NON agile")}, "non_agile"),
        ({**kind("non_agile"), "maneuverability_capability": {"maneuverability_type": "", "type": "Agile"}}, "agile"), ({"attributes": kind("non")}, "non_agile"),
        ({**kind("unknown"), "payload": kind("non-agile")}, "non_agile"), ({"payload": {"attributes": kind("non")}, "payloads": [kind("agile")]}, "non_agile"),
        ({"payloads": [{}, kind("?"), {"attributes": kind("non")}, kind("agile")]}, "non_agile"), ({"payloads": []}, "agile"),
    ]
    (tmp_path / "s.json").write_text(json.dumps({"satellites": [{"id": str(i), **c} for i, (c, _) in enumerate(cases)]}))
    got = files.read_scenarios(spark, str(tmp_path / "s.json"))["satellite"].collect()
    assert {int(r.satellite_id): r.maneuverability for r in got} == {i: want for i, (_, want) in enumerate(cases)}


def test_targets_must_be_there(spark, tmp_path):
    (tmp_path / "t.json").write_text("{}")
    with pytest.raises(Exception, match="no target in"):
        files.read_targets(spark, str(tmp_path / "t.json")).collect()


def test_discovery_rules(spark, tmp_path):
    top = tmp_path / "schedules"  # the given folder itself may have that name
    for name in ("Scenario_a.json", "scenario_b.JSON", "x/scenario_c.json", "x/schedules/Scenario_d.json", "schedules/Scenario_e.json", "other.json", "one_Schedule.json", "scheduler_f.json", "scenario_g.txt"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("{}")
    found = lambda rule, folder=top: {r.path.rsplit("/", 1)[1] for r in files.discover(spark, str(folder), rule).collect()}
    assert found("analysis") == {"Scenario_a.json", "scenario_b.JSON", "scenario_c.json"}
    assert found("scheduling") == {"Scenario_a.json"} == found("scheduling", f"file://{top}/")
    assert found("training") == {"Scenario_a.json", "scenario_b.JSON", "scenario_c.json", "Scenario_d.json", "other.json"}


def test_manifests_and_summaries(spark, tmp_path):
    trace = spark.createDataFrame([("s1", 2, "ok"), ("s2", 1, "bad")], "schedule_file string, steps int, a string")
    state = spark.createDataFrame([("s1", i, i * 0.5) for i in (2, 0, 1)], "schedule_file string, step int, v double")
    for _ in range(2):
        files.write_manifests(trace, state, str(tmp_path / "m"))
    assert sorted(spark.read.text(str(tmp_path / "m/trace")).drop("schedule_file").toPandas()["value"]) == ['{"a":"bad","steps":1}', '{"a":"ok","steps":2}']
    (part,) = (tmp_path / "m/states/schedule_file=s1").glob("part-*")
    assert [json.loads(x)["step"] for x in part.read_text().splitlines()] == [0, 1, 2]
    rows = spark.createDataFrame([("f1", "g", 1.0), ("f2", "g", 4.0), ("f3", None, None)], "file string, grp string, x double")
    files.write_summaries(rows, "grp", str(tmp_path / "s"))
    got = {(r.grp, r.files, r.x) for r in spark.read.option("header", True).csv(str(tmp_path / "s/AveragedSummary")).collect()}
    assert got == {("g", "2", "2.5"), (None, "1", None)} and spark.read.option("header", True).csv(str(tmp_path / "s/CombinedSummary")).count() == 3


def test_schedule_files(spark, tmp_path):
    body = {"scenario_id": "one", "unassigned_tasks": ["M2"], "metrics": {"TP": 3.0}, "assignments": [{"task_id": "M1", "satellite_id": "A", "sat_start_time": "2025-01-01T00:00:10Z"}]}
    (tmp_path / "s.json").write_text(json.dumps(body))
    t = files.read_schedules(spark, str(tmp_path / "s.json"))
    assert t["assignment"].first().schedule_file == "s.json"
    doc = json.loads(files.schedule_documents(t["assignment"], t["unassigned"], t["metrics"]).first()["json"])
    assert doc["unassigned_tasks"] == ["M2"] and doc["metrics"] == {"TP": 3.0}
    doc = json.loads(files.schedule_documents(t["assignment"].limit(0), t["unassigned"], t["metrics"]).first()["json"])  # no assignment: still a schedule
    assert doc["scenario_id"] == "one" and doc["assignments"] == [] and doc["unassigned_tasks"] == ["M2"]


def test_constellation_target_and_trajectory_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"S1": ["LEO", 7000.0, 0.0, 97.5, 0, 10, "x", "18 Nov 2025 12:00:00.000"]}')
    (tmp_path / "t.json").write_text('{"P": [10.0, 95.0], "Q": [120.123456789, 30.0]}')
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nbroken\n')
    c = files.read_constellation(spark, str(tmp_path / "c.json")).first()
    assert c.semi_major_axis_km == 7000.0 and c.mean_anomaly is None
    assert (c.sensor_id, c.data_rate_mbps, c.power_w, c.max_power_w, c.antenna_concurrent) == ("S1_sensor", 0.1, 50.0, 500.0, False)
    got = {r.name: (r.lon, r.lat) for r in files.read_targets(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"P": (95.0, 10.0), "Q": (120.123457, 30.0)}
    for name in ("c", "t"):  # written over several lines, as people do
        body = json.loads((tmp_path / f"{name}.json").read_text())
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    assert files.read_constellation(spark, str(tmp_path / "c.json")).collect() == [c]
    assert {r.name: (r.lon, r.lat) for r in files.read_targets(spark, str(tmp_path / "t.json")).collect()} == got
    j = files.read_trajectories(spark, str(tmp_path / "j.jsonl"), "a int").cache()
    assert j.where("corrupt IS NOT NULL").count() == 1


def test_labels_with_other_payloads_are_an_error(spark):
    store = spark.createDataFrame([("k", "1")], "key string, payload string")
    assert files.new_labels(store, spark.createDataFrame([("k", "1"), ("n", "2")], "key string, payload string")).count() == 1
    with pytest.raises(Exception, match="payloads differ"):
        files.new_labels(store, spark.createDataFrame([("k", "2")], "key string, payload string")).collect()


def test_shuffle_does_not_depend_on_partitions(spark):
    df = spark.range(50)
    one = [r.id for r in files.shuffled(df.repartition(7), "id", 3).collect()]
    assert one == [r.id for r in files.shuffled(df.coalesce(1), "id", 3).collect()] and sorted(one) == list(range(50))
