"""Names and classes, identity checks, keys and features of choices, other ways to list candidates, reports and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.functions import exprs
from orbweave.operators.candidates import CANDIDATE_SQL, candidates_of, windows_of
from orbweave.operators.schedules import KEY
from orbweave.tables import BOUND, HORIZON_S, STEP_S, Scenarios

HEURISTICS = ("profit_first", "completion_first", "timeliness_first", "balance_first", "random")


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def schedule_names(spark, sf_dir: str) -> DataFrame:
    """Schedule names made of orders, read back: solver, class, objective, weights and label."""
    o = Scenarios(spark, sf_dir).raw("orders")
    k = F.col("o_orderkey")
    weights = F.concat(F.lit("p1_c0."), text(k % 10), F.lit("_t0_b"), text(k % 3))
    solver = F.get(F.array(*map(F.lit, HEURISTICS)), (k % 5).cast("int"))
    stem = F.concat(
        F.lit("scheduler_cities_01_S"), text(k),
        F.when(k % 7 == 0, F.concat(F.lit("_c1_mip_"), weights)).when(k % 7 == 1, F.concat(F.lit("_c2_"), solver, F.lit("_implicit")))
        .when(k % 7 == 2, F.concat(F.lit("_c3_sa_"), weights)).when(k % 7 == 3, F.concat(F.lit("_c4_ppo_net.v2_"), weights)).when(k % 7 == 4, F.lit("_c4_ppo_plain"))
        .when(k % 7 == 5, F.concat(F.lit("_c3_tabu_"), weights)).otherwise("_final"),
    )
    n = o.select("o_orderkey", exprs.schedule_name(stem).alias("n")).select("o_orderkey", "n.*")
    w = [F.col("weights")[i] for i in range(4)]
    return n.select(
        "o_orderkey", "solver", "class_id", "objective", "model", *[x.alias(f"w{i}") for i, x in enumerate(w)],
        exprs.objective_label(F.col("class_id"), F.col("solver"), w).alias("label"),
    )


def scale_names(spark, sf_dir: str) -> DataFrame:
    """Scales read from scenario names made of parts."""
    p = Scenarios(spark, sf_dir).raw("part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("cities_0"), text(k % 10), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("_Sats"), text("p_size"))), F.lit("_M"), text(k), F.lit("_T0.5d"))
    return p.select("p_partkey", exprs.scale_of(name).alias("s")).select("p_partkey", "s.*")


def distinct_by_orbit(rows: DataFrame, key: str, name: str) -> DataFrame:
    """scenario_id, orbit_number, whole, name: distinct values of key in each orbit, and in the whole scenario (without
    orbit). Each value is a row of two narrow columns, nothing is multiplied for the totals."""
    orbits = rows.select("scenario_id", "orbit_number", key).distinct().groupBy("scenario_id", "orbit_number").agg(F.count(key).alias(name)).withColumn("whole", F.lit(False))
    whole = rows.select("scenario_id", key).distinct().groupBy("scenario_id").agg(F.count(key).alias(name)).select("scenario_id", F.lit(None).cast("long").alias("orbit_number"), name, F.lit(True).alias("whole"))
    return orbits.unionByName(whole)


def scenario_classes(spark, sf_dir: str) -> DataFrame:
    """Size class of each scenario, and of one orbit of it."""
    t = Scenarios(spark, sf_dir)
    stations = F.broadcast(t.comm_window.agg(F.countDistinct("station_id").alias("stations")))  # one row
    w = t.window_row.where("scenario_id IS NOT NULL").select("scenario_id", "orbit_number", "satellite_id", "task_id")
    sizes = distinct_by_orbit(w, "satellite_id", "satellites").join(distinct_by_orbit(w, "task_id", "missions").withColumnsRenamed({"scenario_id": "s", "orbit_number": "o", "whole": "w"}), F.expr("scenario_id = s AND orbit_number <=> o AND whole = w"))
    sizes = sizes.crossJoin(stations)
    kind = exprs.size_class(F.col("satellites"), F.col("missions"), F.col("stations"))
    return sizes.select("scenario_id", "orbit_number", "satellites", "missions", kind.alias("size_class"))


def identity_violations(spark, sf_dir: str) -> DataFrame:
    """Repeated ids, and windows whose duration is not positive, as rows."""
    t = Scenarios(spark, sf_dir)
    line = t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    repeated = line.select(F.lit("window").alias("kind"), F.concat_ws("/", text("l_orderkey"), text("l_linenumber")).alias("id"), "n")
    satellite = t.satellite.groupBy("satellite_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("satellite").alias("kind"), text("satellite_id").alias("id"), "n")
    mission = t.raw("orders").groupBy("o_orderkey").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("mission").alias("kind"), text("o_orderkey").alias("id"), "n")
    short = t.task_window.where("end_s <= start_s").select(F.lit("duration").alias("kind"), text("window_id").alias("id"), F.lit(1).cast("long").alias("n"))
    return repeated.unionByName(satellite).unionByName(mission).unionByName(short)


def window_lookup(task_window: DataFrame, **wanted) -> DataFrame:
    """Windows whose columns have the wanted values; a value of None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            task_window = task_window.where(F.col(name) == value)
    return task_window


def return_windows(spark, sf_dir: str) -> DataFrame:
    """Windows of the first orbit with flag R."""
    w = window_lookup(Scenarios(spark, sf_dir).task_window, orbit_number=1, flag="R", satellite_id=None)
    return w.select("scenario_id", "window_id", "satellite_id", "task_id", "start_s", "end_s")


def first_names(spark, sf_dir: str) -> DataFrame:
    """The first twenty parts, by name and key, whose names include a text."""
    p = Scenarios(spark, sf_dir).raw("part")
    return p.where(F.col("p_name").contains("a")).orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


def action_keys(spark, sf_dir: str) -> DataFrame:
    """Canonical key of each step's choice, skips included, and its digest."""
    t = Scenarios(spark, sf_dir)
    a = t.kept_assignment.select(*KEY, "task_id", "satellite_id", "orbit_number", "window_id", "sat_start_s", "sat_end_s")
    s = a.select(*KEY).distinct().join(t.task.select("scenario_id", "task_id"), "scenario_id").join(a, [*KEY, "task_id"], "left")
    us = lambda c: (F.col(c) * 1_000_000).cast("long")
    key = exprs.action_key(F.col("task_id"), F.col("satellite_id"), F.lit("main"), F.col("orbit_number"), F.col("window_id"), us("sat_start_s"), us("sat_end_s"))
    return s.select(*KEY, "task_id", key.alias("action_key"), F.sha2(key, 256).alias("digest"))


def candidate_vectors(spark, sf_dir: str) -> DataFrame:
    """The scaled features of the first three candidates of each task, and of the skip at place 0."""
    t = Scenarios(spark, sf_dir)
    c = candidates_of(t, 3).select("scenario_id", "task_id", "place_rank", "c_start_s", "c_end_s", "data_volume_gb", "power_w", "orbit_number", "priority")
    skip = t.task.select("scenario_id", "task_id", F.lit(0).alias("place_rank"), *[F.lit(None).cast(k).alias(n) for n, k in (("c_start_s", "long"), ("c_end_s", "long"), ("data_volume_gb", "double"), ("power_w", "double"), ("orbit_number", "long"))], "priority")
    none = F.lit(None).cast("long")
    f = exprs.candidate_features(*[F.col(n) for n in ("c_start_s", "c_end_s", "data_volume_gb", "power_w", "orbit_number", "priority")], none, none)
    rows = c.unionByName(skip).withColumn("f", exprs.scaled_features(f))
    names = ("is_skip", "start", "end", "duration", "volume", "power", "orbit", "priority", "link_start", "link_length")
    return rows.select("scenario_id", "task_id", "place_rank", *[F.round(F.col("f")[i], 6).alias(f"f_{n}") for i, n in enumerate(names)])


def window_desirability(spark, sf_dir: str) -> DataFrame:
    """Static worth, finish and busy time of each task's earliest placement in each window, with a downlink in every second one."""
    t = Scenarios(spark, sf_dir)
    total = t.task.groupBy("scenario_id").agg(F.sum("priority").alias("possible"))
    w = t.task_window.join(t.task, ["scenario_id", "task_id"]).join(total, "scenario_id")
    end = F.col("start_s") + F.col("duration_s")
    gs0 = F.when(F.col("window_id") % 2 == 0, end + 30)
    gs1 = gs0 + F.col("duration_s")
    worth = exprs.desirability(F.col("priority"), F.col("possible"), F.col("start_s"), F.lit(HORIZON_S), (0.5, 0.2, 0.3))
    return w.select("scenario_id", "window_id", F.round(worth, 6).alias("worth"), exprs.finish_s(end, gs1).alias("finish_s"), exprs.busy_s(F.col("start_s"), end, gs0, gs1).alias("busy_s"))


def exact_matches(spark, sf_dir: str) -> DataFrame:
    """How many enumerated candidates each assignment equals in window and start; there should be one."""
    t = Scenarios(spark, sf_dir)
    w = windows_of(t.placed_window, t.satellite).select("scenario_id", "task_id", "window_id", "start_s", "step_s", "ks")
    found = F.size(F.filter("ks", lambda k: F.col("start_s") + k * F.col("step_s") == F.col("sat_start_s")))  # candidates of a window differ in start
    n = t.assignment.join(w, ["scenario_id", "task_id", "window_id"], "left").groupBy(*KEY, "task_id").agg(F.sum(F.when(F.col("ks").isNotNull(), found).otherwise(0)).alias("matches"))
    return n.groupBy(*KEY, "matches").agg(F.count("*").alias("rows"))


def analysis_candidates(spark, sf_dir: str, multiple: int = 3, cap: int = 5) -> DataFrame:
    """Candidates as the difficulty analysis lists them (C07): a multiple of the step, the centre clipped for satellites
    that cannot turn, the first of each task kept."""
    t = Scenarios(spark, sf_dir)
    step = multiple * STEP_S
    slack = F.col("end_s") - F.col("start_s") - F.col("duration_s")
    w = t.task_window.join(t.task, ["scenario_id", "task_id"]).join(t.satellite.select("satellite_id", "maneuverability"), "satellite_id").where(slack >= 0)
    last = F.floor(slack / step)
    middle = F.least(F.greatest(F.bround(slack / 2 / step), F.lit(0)), last).cast("long")
    few = F.sequence(F.lit(0).cast("long"), F.least(last, F.lit(cap - 1)))  # a window never keeps more than the task does
    w = w.withColumn("k", F.explode(F.when(F.col("maneuverability") == "non_agile", F.array(middle)).otherwise(few)))
    order = Window.partitionBy("scenario_id", "task_id").orderBy("start_s", "window_id", "k")
    return w.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("scenario_id", "task_id", "window_id", "k", "place", (F.col("start_s") + F.col("k") * step).alias("c_start_s"))


def _share(*parts) -> Column:
    """A reproducible number of 0 to 999 from texts."""
    return exprs.stable_seed(F.concat_ws("|", *parts)) % 1000


def random_downlinks(spark, sf_dir: str, extra: int = 2) -> DataFrame:
    """Further downlink placements of each earliest candidate in each contact, at hashed shares of the slack."""
    t = Scenarios(spark, sf_dir)
    w = t.task_window.join(t.task, ["scenario_id", "task_id"]).where(F.col("end_s") - F.col("start_s") >= F.col("duration_s"))
    c = w.select("scenario_id", "window_id", "satellite_id", "duration_s", (F.col("start_s") + F.col("duration_s")).alias("c_end_s"))
    g = t.comm_window.select("satellite_id", "comm_id", F.col("start_s").alias("g0"), F.col("end_s").alias("g1"))
    begin = F.greatest("g0", "c_end_s")
    rows = c.join(g, "satellite_id").withColumn("slack", F.col("g1") - begin - F.col("duration_s")).where("slack >= 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(extra))))
    share = _share(text("scenario_id"), text("window_id"), text("comm_id"), text("i"))
    at = begin + F.floor(F.col("slack") * share / 999).cast("long")
    return rows.groupBy("scenario_id", "satellite_id").agg(F.count("*").alias("placements"), F.sum(at).alias("start_sum"))


def shuffled_candidates(spark, sf_dir: str) -> DataFrame:
    """The first three candidates of each task in an order by hash, the same whatever the order of the input."""
    t = Scenarios(spark, sf_dir)
    w = windows_of(t.placed_window, t.satellite)
    h = lambda k: F.md5(F.concat_ws("|", F.lit("7"), F.col("scenario_id"), text("window_id"), text(k)))
    own = F.array_sort(F.transform("ks", lambda k: F.struct(h(k).alias("h"), k.alias("k"))))  # no window has more than three of a task's first three
    c = w.select("scenario_id", "task_id", "window_id", F.inline(F.slice(own, 1, 3)))
    order = Window.partitionBy("scenario_id", "task_id").orderBy("h", "window_id", "k")
    return c.withColumn("place", F.row_number().over(order)).where("place <= 3").drop("h")


def incomplete_summary(spark, sf_dir: str) -> DataFrame:
    """Per instance: queries by status, and states all of whose queries are done (E23). Orders are queries, customers states."""
    o = Scenarios(spark, sf_dir).raw("orders").withColumn("instance", F.concat(F.lit("I"), F.substring("o_orderpriority", 1, 1)))
    per = o.groupBy("instance", "o_custkey").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "done"), ("O", "missing"), ("P", "failed"))], F.bool_and(F.col("o_orderstatus") == "F").alias("whole")
    )
    return per.groupBy("instance").agg(F.sum("n").alias("queries"), *[F.sum(c).alias(c) for c in ("done", "missing", "failed")], F.count_if("whole").alias("states_completed"), F.count("*").alias("states"))


def scenario_hashes(spark, sf_dir: str) -> DataFrame:
    """A digest of what each scenario means, whatever the order of its rows (E27): windows sorted by their business key
    within a satellite, satellites within a thousand, and thousands within the scenario, each level a digest of digests."""
    w = Scenarios(spark, sf_dir).window_row
    key = F.concat_ws("|", *[text(c) for c in ("task_id", "orbit_number", "start_s", "end_s", "seed")])
    sat = w.groupBy("scenario_id", "satellite_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), ";"), 256).alias("h"), F.count("*").alias("n"))
    line = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(text("id"), 12, "0"), "h"))), ";"), 256).alias("h")
    some = sat.select("scenario_id", F.floor(F.col("satellite_id") / 1000).alias("k"), F.col("satellite_id").alias("id"), "h", "n").groupBy("scenario_id", "k").agg(line(), F.sum("n").alias("n"))
    return some.select("scenario_id", F.col("k").alias("id"), "h", "n").groupBy("scenario_id").agg(line(), F.sum("n").alias("windows")).select("scenario_id", F.concat(F.lit("sha256:"), "h").alias("digest"), "windows")


def annotated_states(spark, sf_dir: str) -> DataFrame:
    """All orders with whether they were selected, as the catalog shows a selection (D14): the two of each customer that come first by hash."""
    o = Scenarios(spark, sf_dir).raw("orders").select("o_orderkey", "o_custkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.md5(text("o_orderkey")), "o_orderkey"))
    chosen = o.withColumn("place", place).where("place <= 2").select("o_orderkey", "place")
    return o.join(chosen, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.col("place").isNotNull().alias("selected"), F.coalesce("place", F.lit(0)).alias("place"))


def merged_sources(spark, sf_dir: str) -> DataFrame:
    """Sources of one state made one (D17): line items of an order are its sources, flags their families, the ship year
    an invariant. Canonical is the source first by hash; states with other years or a family twice are told apart."""
    li = Scenarios(spark, sf_dir).raw("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.year("l_shipdate").alias("y"))
    h = F.md5(F.concat_ws("|", text("l_orderkey"), text("l_linenumber")))
    g = li.groupBy("l_orderkey").agg(
        F.count("*").alias("sources"), F.countDistinct("l_returnflag").alias("families"), F.countDistinct("y").alias("years"), F.min_by("l_linenumber", F.struct(h, "l_linenumber")).alias("canonical")
    )
    verdict = F.when(F.col("years") > 1, "invariant_differs").when(F.col("families") < F.col("sources"), "family_repeated").otherwise("merged")
    return g.select(F.col("l_orderkey").alias("state_id"), "sources", "canonical", verdict.alias("verdict"))


def satellite_report_lines(spark, sf_dir: str) -> DataFrame:
    """Report lines of each satellite's conflict segments (A10): times, kind and number of tasks, longest ones as they come."""
    from orbweave.operators.sweeps import conflict_timeline

    s = conflict_timeline(spark, sf_dir)
    clock = lambda c: F.concat_ws(":", *[F.lpad(text(x), 2, "0") for x in (F.floor(F.col(c) / 3600), F.floor(F.col(c) / 60) % 60, F.col(c) % 60)])
    line = F.concat_ws(" | ", F.rpad(text("satellite_id"), 8, " "), clock("start_s"), clock("end_s"), F.rpad("kind", 10, " "), text("n_tasks"))
    return s.select("scenario_id", line.alias("line"))


def row_digests(spark, sf_dir: str) -> DataFrame:
    """Digest of suppliers as JSON with sorted names and nulls kept."""
    s = Scenarios(spark, sf_dir).raw("supplier")
    none = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey"))
    return s.select("s_suppkey", exprs.canonical_digest(name=F.col("s_name"), key=F.col("s_suppkey"), nation=none).alias("digest"))


QUERIES = {
    "schedule_names": (
        schedule_names,
        """WITH n AS (SELECT *, o_orderkey % 7 AS c, ['profit_first', 'completion_first', 'timeliness_first', 'balance_first', 'random'][o_orderkey % 5 + 1] AS h,
          'p1_c0.' || o_orderkey % 10 || '_t0_b' || o_orderkey % 3 AS w, CAST('0.' || o_orderkey % 10 AS DOUBLE) AS wc, CAST(o_orderkey % 3 AS DOUBLE) AS wb FROM orders)
        SELECT o_orderkey, CASE c WHEN 0 THEN 'mip' WHEN 1 THEN h WHEN 2 THEN 'sa' WHEN 3 THEN 'ppo' WHEN 4 THEN 'ppo' ELSE 'unknown' END AS solver,
          CAST(CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 4 ELSE -1 END AS INTEGER) AS class_id,
          CASE WHEN c IN (0, 2, 3) THEN w WHEN c IN (1, 4) THEN 'implicit' ELSE 'unknown' END AS objective, CASE c WHEN 3 THEN 'net.v2' WHEN 4 THEN 'plain' END AS model,
          CASE WHEN c IN (0, 2, 3) OR c = 1 AND h = 'profit_first' THEN 1.0::DOUBLE ELSE 0 END AS w0, CASE WHEN c IN (0, 2, 3) THEN wc WHEN c = 1 AND h = 'completion_first' THEN 1 ELSE 0 END AS w1,
          CASE WHEN c = 1 AND h = 'timeliness_first' THEN 1.0::DOUBLE ELSE 0 END AS w2, CASE WHEN c IN (0, 2, 3) THEN wb WHEN c = 1 AND h = 'balance_first' THEN 1 ELSE 0 END AS w3,
          CASE WHEN c IN (0, 2, 3) THEN 'profit=1,completion=' || CASE WHEN o_orderkey % 10 = 0 THEN '0' ELSE '0.' || o_orderkey % 10 END || ',timeliness=0,balance=' || o_orderkey % 3
            WHEN c = 4 THEN 'profit=0,completion=0,timeliness=0,balance=0' WHEN c = 1 THEN 'implicit(' || h || ')' ELSE 'N/A' END AS label FROM n""",
    ),
    "scale_names": (scale_names, "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS INTEGER) END AS satellites, CAST(p_partkey AS INTEGER) AS missions, 0.5::DOUBLE AS days, 'cities_0' || p_partkey % 10 AS alias FROM part"),
    "scenario_classes": (
        scenario_classes,
        BOUND + """ SELECT scenario_id, orbit_number, satellites, missions, CASE WHEN satellites <= 3 AND missions <= 20 AND g <= 3 THEN 'basic' WHEN satellites > 10 OR missions > 200 OR g > 5 THEN 'multi_sat_multi_gs' ELSE 'other' END AS size_class
        FROM (SELECT scenario_id, orbit_number, count(DISTINCT satellite_id) AS satellites, count(DISTINCT task_id) AS missions FROM task_window GROUP BY ROLLUP (scenario_id, orbit_number)),
          (SELECT count(DISTINCT station_id) AS g FROM comm_window) WHERE scenario_id IS NOT NULL""",
    ),
    "identity_violations": (
        identity_violations,
        BOUND + """ SELECT 'window' AS kind, l_orderkey || '/' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
        UNION ALL SELECT 'satellite', CAST(s_suppkey AS VARCHAR), count(*) FROM supplier GROUP BY s_suppkey HAVING count(*) > 1
        UNION ALL SELECT 'mission', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1
        UNION ALL SELECT 'duration', CAST(window_id AS VARCHAR), 1 FROM task_window WHERE end_s <= start_s""",
    ),
    "return_windows": (return_windows, BOUND + " SELECT scenario_id, window_id, satellite_id, task_id, start_s, end_s FROM task_window WHERE orbit_number = 1 AND flag = 'R'"),
    "first_names": (first_names, "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') ORDER BY p_name, p_partkey LIMIT 20"),
    "action_keys": (
        action_keys,
        BOUND + """ SELECT *, sha256(action_key) AS digest FROM (SELECT scenario_id, schedule_id, task_id, CASE WHEN window_id IS NULL THEN 'skip|' || task_id ELSE
          'assign|' || task_id || '|' || satellite_id || '|main|' || orbit_number || '|' || window_id || '|' || sat_start_s * 1000000 || '|' || sat_end_s * 1000000 END AS action_key
        FROM (SELECT * FROM (SELECT DISTINCT scenario_id, schedule_id FROM assignment) JOIN task USING (scenario_id)) LEFT JOIN (SELECT * EXCLUDE (priority, duration_s) FROM assignment) USING (scenario_id, schedule_id, task_id))""",
    ),
    "candidate_vectors": (
        candidate_vectors,
        BOUND + "," + CANDIDATE_SQL + """ SELECT scenario_id, task_id, CAST(place_rank AS INTEGER) AS place_rank, 0.0::DOUBLE AS f_is_skip, round(c_start_s / 43200::DOUBLE, 6) AS f_start, round(c_end_s / 43200::DOUBLE, 6) AS f_end,
          round(duration_s / 100::DOUBLE, 6) AS f_duration, round(data_volume_gb / 0.01::DOUBLE, 6) AS f_volume, round(power_w / 500::DOUBLE, 6) AS f_power, round(orbit_number / 10::DOUBLE, 6) AS f_orbit,
          round(priority / 10::DOUBLE, 6) AS f_priority, 0.0::DOUBLE AS f_link_start, 0.0::DOUBLE AS f_link_length FROM candidate WHERE place_rank <= 3
        UNION ALL SELECT scenario_id, task_id, 0, 1, 0, 0, 0, 0, 0, 0, round(priority / 10::DOUBLE, 6), 0, 0 FROM task""",
    ),
    "window_desirability": (
        window_desirability,
        BOUND + """ SELECT scenario_id, window_id, round(greatest(1e-6, 0.5::DOUBLE * priority / possible + 0.2::DOUBLE + 0.3::DOUBLE * (1 - least(1, start_s / 3600::DOUBLE))), 6) AS worth,
          CASE WHEN window_id % 2 = 0 THEN start_s + 2 * duration_s + 30 ELSE start_s + duration_s END AS finish_s, CASE WHEN window_id % 2 = 0 THEN 2 * duration_s ELSE duration_s END AS busy_s
        FROM task_window JOIN task USING (scenario_id, task_id) JOIN (SELECT scenario_id, sum(priority) AS possible FROM task GROUP BY ALL) USING (scenario_id)""",
    ),
    "exact_matches": (
        exact_matches,
        BOUND + "," + CANDIDATE_SQL + """ SELECT scenario_id, schedule_id, matches, count(*) AS "rows" FROM (SELECT a.scenario_id, a.schedule_id, a.task_id, count(c.k) AS matches FROM assignment a
          LEFT JOIN candidate c ON c.scenario_id = a.scenario_id AND c.task_id = a.task_id AND c.window_id = a.window_id AND c.c_start_s = a.sat_start_s GROUP BY ALL) GROUP BY ALL""",
    ),
    "analysis_candidates": (
        analysis_candidates,
        BOUND + """ SELECT scenario_id, task_id, window_id, k, place, start_s + k * 30 AS c_start_s FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id, task_id ORDER BY start_s, window_id, k) AS INTEGER) AS place FROM (
          SELECT *, unnest(CASE WHEN maneuverability = 'non_agile' THEN [least(greatest(CAST(round_even(s / 2 / 30, 0) AS BIGINT), 0), s // 30)] ELSE range(0, s // 30 + 1) END) AS k FROM (
            SELECT *, end_s - start_s - duration_s AS s FROM task_window JOIN task USING (scenario_id, task_id) JOIN satellite USING (satellite_id)) WHERE s >= 0)) WHERE place <= 5""",
    ),
    "random_downlinks": (
        random_downlinks,
        BOUND + """ SELECT scenario_id, satellite_id, count(*) AS placements, CAST(sum(b + s * ((CAST('0x' || substr(md5(scenario_id || '|' || window_id || '|' || comm_id || '|' || i), 1, 8) AS BIGINT) & 2147483647) % 1000) // 999) AS BIGINT) AS start_sum
        FROM (SELECT *, unnest([1, 2]) AS i FROM (SELECT w.scenario_id, w.window_id, w.satellite_id, comm_id, greatest(m.start_s, w.start_s + duration_s) AS b, m.end_s - greatest(m.start_s, w.start_s + duration_s) - duration_s AS s
          FROM task_window w JOIN task USING (scenario_id, task_id) JOIN comm_window m USING (satellite_id) WHERE w.end_s - w.start_s >= duration_s) WHERE s >= 0) GROUP BY ALL""",
    ),
    "shuffled_candidates": (
        shuffled_candidates,
        BOUND + "," + CANDIDATE_SQL + """ SELECT scenario_id, task_id, window_id, k, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id, task_id ORDER BY md5('7|' || scenario_id || '|' || window_id || '|' || k), window_id, k) AS INTEGER) AS place
        FROM candidate) WHERE place <= 3""",
    ),
    "incomplete_summary": (
        incomplete_summary,
        """SELECT instance, CAST(sum(n) AS BIGINT) AS queries, CAST(sum(f) AS BIGINT) AS done, CAST(sum(o) AS BIGINT) AS missing, CAST(sum(p) AS BIGINT) AS failed, count(*) FILTER (f = n) AS states_completed, count(*) AS states
        FROM (SELECT 'I' || substr(o_orderpriority, 1, 1) AS instance, o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p
          FROM orders GROUP BY ALL) GROUP BY instance""",
    ),
    "scenario_hashes": (
        scenario_hashes,
        BOUND + """, s AS (SELECT scenario_id, satellite_id, sha256(string_agg(x, ';' ORDER BY x)) AS h, count(*) AS n FROM (SELECT scenario_id, satellite_id, task_id || '|' || orbit_number || '|' || start_s || '|' || end_s || '|' || seed AS x FROM task_window) GROUP BY ALL),
        k AS (SELECT scenario_id, satellite_id // 1000 AS k, sha256(string_agg(lpad(CAST(satellite_id AS VARCHAR), 12, '0') || ':' || h, ';' ORDER BY satellite_id)) AS h, sum(n) AS n FROM s GROUP BY ALL)
        SELECT scenario_id, 'sha256:' || sha256(string_agg(lpad(CAST(k AS VARCHAR), 12, '0') || ':' || h, ';' ORDER BY k)) AS digest, CAST(sum(n) AS BIGINT) AS windows FROM k GROUP BY scenario_id""",
    ),
    "annotated_states": (
        annotated_states,
        """SELECT o_orderkey, o_custkey, r <= 2 AS selected, CAST(CASE WHEN r <= 2 THEN r ELSE 0 END AS INTEGER) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders)""",
    ),
    "merged_sources": (
        merged_sources,
        """SELECT l_orderkey AS state_id, count(*) AS sources, (min(row(md5(l_orderkey || '|' || l_linenumber), l_linenumber)))[2] AS canonical,
        CASE WHEN count(DISTINCT year(l_shipdate)) > 1 THEN 'invariant_differs' WHEN count(DISTINCT l_returnflag) < count(*) THEN 'family_repeated' ELSE 'merged' END AS verdict FROM lineitem GROUP BY l_orderkey""",
    ),
    "row_digests": (
        row_digests,
        """SELECT s_suppkey, 'sha256:' || sha256('{"key":' || s_suppkey || ',"name":"' || s_name || '","nation":' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'null' END || '}') AS digest FROM supplier""",
    ),
}


def _report_sql() -> str:
    from orbweave.operators.sweeps import QUERIES as sweeps

    clock = lambda c: f"lpad(CAST({c} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} % 60 AS VARCHAR), 2, '0')"
    return f"""SELECT scenario_id, rpad(CAST(satellite_id AS VARCHAR), 8, ' ') || ' | ' || {clock('start_s')} || ' | ' || {clock('end_s')} || ' | ' || rpad(kind, 10, ' ') || ' | ' || n_tasks AS line
    FROM ({sweeps['conflict_timeline'][1]})"""


QUERIES["satellite_report_lines"] = (satellite_report_lines, _report_sql())
