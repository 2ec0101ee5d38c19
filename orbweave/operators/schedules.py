"""Schedules: feasibility audit, metrics, comparison, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.functions.exprs import attitude_change, transition_bound_s, transition_s
from orbweave.operators.candidates import attitude
from orbweave.plans.range_join import follows_within
from orbweave.tables import BOUND, HORIZON_S, STEP_S, Scenarios

KEY = ["scenario_id", "schedule_id"]
#: Weights of profit, completion, timeliness and balance in the score of a schedule.
WEIGHTS = (0.4, 0.3, 0.2, 0.1)


def posed(assignment: DataFrame, satellite: DataFrame) -> DataFrame:
    """assignments with maneuverability and the attitude at both ends."""
    last = F.floor(F.col("duration_s") / STEP_S)
    first, end = (attitude(F.col("seed"), F.col("satellite_id"), k) for k in (F.lit(0), last))
    return assignment.join(satellite.select("satellite_id", "maneuverability"), "satellite_id").withColumns(
        {"roll0": first[0], "pitch0": first[1], "roll1": end[0], "pitch1": end[1]}
    )


def _turn(prefix: str = "r_"):
    change = attitude_change([F.col("roll1"), F.col("pitch1")], [F.col(f"{prefix}roll0"), F.col(f"{prefix}pitch0")])
    return transition_s(change, agile=F.col("maneuverability") == "agile")


def satellite_violations(assignment: DataFrame, satellite: DataFrame) -> DataFrame:
    """Pairs of assignments of a schedule on one satellite that overlap or leave too little time to turn."""
    a = posed(assignment, satellite).select(
        *KEY, "satellite_id", "task_id", "window_id", "sat_start_s", "sat_end_s", "maneuverability", "roll0", "pitch0", "roll1", "pitch1"
    )
    reach = F.col("sat_end_s") - F.col("sat_start_s") + int(transition_bound_s())
    pairs = follows_within(a, a.drop("maneuverability"), [*KEY, "satellite_id"], "sat_start_s", reach, 158)
    later = F.struct("r_sat_start_s", "r_task_id") > F.struct("sat_start_s", "task_id")
    overlap = F.col("r_sat_start_s") < F.col("sat_end_s")
    return pairs.where(later & (overlap | (F.col("sat_end_s") + _turn() > F.col("r_sat_start_s")))).withColumn(
        "kind", F.when(overlap, "satellite_overlap").otherwise("transition")
    )


def orbit_usage(assignment: DataFrame, satellite: DataFrame) -> DataFrame:
    """Storage and power of each satellite and orbit against the limits (E16); a limit of 0 means none."""
    used = assignment.join(satellite, "satellite_id").groupBy(*KEY, "satellite_id", "orbit_number").agg(
        F.sum(F.col("data_rate_mbps") * F.col("duration_s") / (8 * 1024)).alias("storage_gb"),
        F.sum("power_w").alias("power_w"),
        F.max("max_storage_gb").alias("max_storage_gb"),
        F.max("max_power_w").alias("max_power_w"),
    )
    over = lambda x, limit: (F.col(limit) > 0) & (F.col(x) > F.col(limit) + 1e-9)
    return used.withColumns({"storage_over": over("storage_gb", "max_storage_gb"), "power_over": over("power_w", "max_power_w")})


def audit(assignment: DataFrame, task: DataFrame, satellite: DataFrame) -> DataFrame:
    """Number of violations of each schedule by kind (D10): repeated tasks, wrong durations, satellite overlaps, short
    transitions, storage and power per orbit. Schedules without a violation have no rows."""
    repeated = assignment.groupBy(*KEY, "task_id").agg(F.count("*").alias("n")).where("n > 1").select(*KEY, F.lit("repeated_task").alias("kind"))
    wrong = (
        assignment.drop("duration_s").join(task.select("scenario_id", "task_id", "duration_s"), ["scenario_id", "task_id"], "left")
        .where(~F.col("duration_s").eqNullSafe(F.col("sat_end_s") - F.col("sat_start_s"))).select(*KEY, F.lit("duration").alias("kind"))
    )
    pairs = satellite_violations(assignment, satellite).select(*KEY, "kind")
    usage = orbit_usage(assignment, satellite)
    storage = usage.where("storage_over").select(*KEY, F.lit("storage").alias("kind"))
    power = usage.where("power_over").select(*KEY, F.lit("power").alias("kind"))
    return repeated.unionByName(wrong).unionByName(pairs).unionByName(storage).unionByName(power).groupBy(*KEY, "kind").agg(F.count("*").alias("violations"))


def neighbour_check(assignment: DataFrame, satellite: DataFrame) -> DataFrame:
    """Assignments that clash with the one before them on their satellite."""
    order = Window.partitionBy(*KEY, "satellite_id").orderBy("sat_start_s", "task_id")
    a = posed(assignment, satellite)
    for c in ("sat_end_s", "roll1", "pitch1"):
        a = a.withColumn(f"p_{c}", F.lag(c).over(order))
    change = attitude_change([F.col("p_roll1"), F.col("p_pitch1")], [F.col("roll0"), F.col("pitch0")])
    turn = transition_s(change, agile=F.col("maneuverability") == "agile")
    return a.where(F.col("p_sat_end_s").isNotNull() & (F.col("p_sat_end_s") + turn > F.col("sat_start_s")))


def schedule_metrics(assignment: DataFrame, task: DataFrame, satellite: DataFrame) -> DataFrame:
    """Per schedule: profit, completion, timeliness, balance and the weighted score.

    Unscheduled tasks count with the whole horizon as delay; the last assignment of a task counts; idle satellites
    count in the balance.
    """
    runs = assignment.select(*KEY).distinct()
    last = Window.partitionBy(*KEY, "task_id").orderBy(F.desc("sat_start_s"), F.desc("window_id"))
    one = assignment.withColumn("r", F.row_number().over(last)).where("r = 1").select(*KEY, "task_id", "sat_start_s")
    tasks = runs.join(task, "scenario_id").join(one, [*KEY, "task_id"], "left")
    done = F.col("sat_start_s").isNotNull()
    per_task = tasks.groupBy(*KEY).agg(
        F.sum(F.when(done, F.col("priority")).otherwise(0)).alias("profit"),
        F.sum("priority").alias("possible"),
        F.avg(done.cast("double")).alias("completion"),
        F.avg(F.coalesce(F.col("sat_start_s"), F.lit(HORIZON_S)) / HORIZON_S).alias("delay"),
        F.sum("duration_s").alias("required_s"),
    )
    busy = assignment.groupBy(*KEY, "satellite_id").agg(F.sum(F.col("sat_end_s") - F.col("sat_start_s")).alias("busy_s"))
    n = satellite.agg(F.count("*").alias("n"))
    totals = busy.groupBy(*KEY).agg(F.sum("busy_s").alias("total_s"), F.count("*").alias("used"))
    mean = totals.crossJoin(F.broadcast(n)).withColumn("mean_s", F.col("total_s") / F.col("n"))  # one row
    off = (
        busy.join(mean, KEY).groupBy(*KEY).agg(F.sum(F.abs(F.col("busy_s") - F.col("mean_s"))).alias("off_s"), F.max((F.col("n") - F.col("used")) * F.col("mean_s")).alias("idle_s"))
    )
    w = WEIGHTS
    out = per_task.join(off, KEY, "left")
    balance = F.greatest(F.least(1 - F.try_divide(F.col("off_s") + F.col("idle_s"), 2 * F.col("required_s")), F.lit(1.0)), F.lit(0.0))
    out = out.withColumns({"balance": F.coalesce(balance, F.lit(0.0)), "timeliness": F.greatest(1 - F.col("delay"), F.lit(0.0))})
    score = w[0] * F.col("profit") / F.col("possible") + w[1] * F.col("completion") + w[2] * F.col("timeliness") + w[3] * F.col("balance")
    return out.select(*KEY, "profit", F.round("completion", 6).alias("completion"), F.round("delay", 6).alias("delay"), F.round("balance", 6).alias("balance"), F.round(score, 6).alias("score"))


def _all(spark, sf_dir):
    t = Scenarios(spark, sf_dir)
    return t.kept_assignment, t.task, t.satellite


def schedule_audit(spark, sf_dir):
    return audit(*_all(spark, sf_dir))


def schedule_neighbour_clashes(spark, sf_dir):
    a, _, s = _all(spark, sf_dir)
    return neighbour_check(a, s).groupBy(*KEY).agg(F.count("*").alias("clashes"))


def schedule_evaluation(spark, sf_dir):
    return schedule_metrics(*_all(spark, sf_dir))


def unassigned_tasks(spark, sf_dir):
    """Tasks of each scenario that a schedule leaves out."""
    a, task, _ = _all(spark, sf_dir)
    runs = a.select(*KEY).distinct()
    return runs.join(task.select("scenario_id", "task_id", "priority"), "scenario_id").join(a.select(*KEY, "task_id"), [*KEY, "task_id"], "left_anti")


def orbit_capacity(spark, sf_dir):
    a, _, s = _all(spark, sf_dir)
    u = orbit_usage(a, s)
    return u.select(*KEY, "satellite_id", "orbit_number", F.round(F.col("storage_gb") * 8192, 4).alias("storage_mbit"), F.round("power_w", 4).alias("power_w"), "storage_over", "power_over")


def profit_variance(spark, sf_dir):
    """Sample variance of profit over the schedules of a scenario, null for fewer than two (E12); mean over them."""
    a, _, _ = _all(spark, sf_dir)
    p = a.groupBy(*KEY).agg(F.sum("priority").alias("profit"))
    rv = F.when(F.count("*") >= 2, F.var_samp("profit"))
    return p.groupBy("scenario_id").agg(F.count("*").alias("runs"), F.round(F.avg("profit"), 6).alias("mean_profit"), F.round(rv, 4).alias("profit_variance"))


def penalty_objective(spark, sf_dir):
    """Priorities of scheduled tasks less a penalty for each task left out."""
    a, task, _ = _all(spark, sf_dir)
    done = a.groupBy(*KEY).agg(F.sum("priority").alias("profit"), F.countDistinct("task_id").alias("tasks"))
    n = task.groupBy("scenario_id").agg(F.count("*").alias("n"))
    return done.join(n, "scenario_id").select(*KEY, (F.col("profit") - 2 * (F.col("n") - F.col("tasks"))).alias("objective"))


def satellite_load(spark, sf_dir):
    """Mean and population deviation of assignments per satellite, idle ones counted."""
    a, _, s = _all(spark, sf_dir)
    n = a.groupBy(*KEY, "satellite_id").agg(F.count("*").alias("n"))
    total = F.broadcast(s.agg(F.count("*").alias("all")))  # one row; idle satellites add zeros to the sums
    sums = n.groupBy(*KEY).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).crossJoin(total)
    mean = F.col("s") / F.col("all")
    return sums.select(*KEY, F.round(mean, 6).alias("load_mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("all") - mean * mean, F.lit(0.0))), 6).alias("load_std"))


def gantt_bars(spark, sf_dir):
    """Extent of each schedule and its bars as shares of it."""
    a, _, _ = _all(spark, sf_dir)
    a = a.join(a.groupBy(*KEY).agg(F.min("sat_start_s").alias("low"), F.max("sat_end_s").alias("high")), KEY)
    low, span = F.col("low"), F.greatest(F.col("high") - F.col("low"), F.lit(1))
    return a.select(
        *KEY, "task_id", F.round(100 * (F.col("sat_start_s") - low) / span, 4).alias("offset_pct"), F.round(100 * (F.col("sat_end_s") - F.col("sat_start_s")) / span, 4).alias("width_pct")
    )


def active_at(spark, sf_dir):
    """Assignments that run at half time, in order on each satellite."""
    a, _, _ = _all(spark, sf_dir)
    now = HORIZON_S // 2
    order = Window.partitionBy(*KEY, "satellite_id").orderBy("sat_start_s", "task_id")
    return a.where((F.col("sat_start_s") <= now) & (F.col("sat_end_s") > now)).select(*KEY, "satellite_id", "task_id", F.row_number().over(order).alias("place"))


def algorithm_comparison(spark, sf_dir):
    """Metrics of schedules side by side, each over its largest value in the scenario."""
    m = schedule_evaluation(spark, sf_dir)
    w = Window.partitionBy("scenario_id")
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.max(c).over(w).cast("double")), F.lit(0.0))
    rows = m.select("scenario_id", "schedule_id", F.round(share("profit"), 6).alias("profit"), F.round(share("score"), 6).alias("score"))
    names = ["earliest", "longest", "returned"]
    wide = rows.groupBy("scenario_id").pivot("schedule_id", names).agg(F.max("profit").alias("profit"), F.max("score").alias("score"))
    return wide


def job_matrix(spark, sf_dir):
    """Scenarios by algorithm and weights; the exact solver only where there are 20 satellites at most."""
    t = Scenarios(spark, sf_dir)
    n = t.task_window.groupBy("scenario_id").agg(F.countDistinct("satellite_id").alias("satellites"))
    algorithms = spark.createDataFrame([("mip", True), ("sa", True), ("ga", True), ("profit_first", False), ("balance_first", False)], "algorithm string, weighted boolean")
    weights = spark.createDataFrame([("profit", 1.0), ("mixed", 0.25)], "objective string, weight double")
    jobs = n.crossJoin(algorithms).where((F.col("algorithm") != "mip") | (F.col("satellites") <= 20))
    with_weights = jobs.where("weighted").crossJoin(weights)
    single = jobs.where("NOT weighted").select("*", F.lit("implicit").alias("objective"), F.lit(1.0).alias("weight"))
    return with_weights.unionByName(single).select("scenario_id", "algorithm", "objective", "weight")


_POSED = """posed AS (SELECT a.*, maneuverability, seed % 91 - 45 AS roll0, (7 * satellite_id) % 91 - 45 AS pitch0,
  (seed + 3 * (duration_s // 10)) % 91 - 45 AS roll1, (7 * satellite_id + 2 * (duration_s // 10)) % 91 - 45 AS pitch1 FROM assignment a JOIN satellite USING (satellite_id))"""
_TURN = """CAST(CASE WHEN {m} <> 'agile' THEN 10.0 WHEN {g} <= 10 THEN 11.66 WHEN {g} <= 30 THEN 5 + {g} / 1.5::DOUBLE WHEN {g} <= 60 THEN 10 + {g} / 2.0::DOUBLE
  WHEN {g} <= 90 THEN 16 + {g} / 2.5::DOUBLE ELSE 22 + {g} / 3.0::DOUBLE END AS DOUBLE)"""
_USE = """usage AS (SELECT scenario_id, schedule_id, satellite_id, orbit_number, sum(data_rate_mbps * duration_s / (8 * 1024)) AS storage_gb, sum(power_w) AS power_w,
  max(max_storage_gb) > 0 AND sum(data_rate_mbps * duration_s / (8 * 1024)) > max(max_storage_gb) + 1e-9 AS storage_over,
  max(max_power_w) > 0 AND sum(power_w) > max(max_power_w) + 1e-9 AS power_over FROM assignment JOIN satellite USING (satellite_id) GROUP BY ALL)"""
_METRICS = """last AS (SELECT scenario_id, schedule_id, task_id, sat_start_s FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, schedule_id, task_id ORDER BY sat_start_s DESC, window_id DESC) AS r FROM assignment) WHERE r = 1),
 runs AS (SELECT DISTINCT scenario_id, schedule_id FROM assignment),
 per AS (SELECT scenario_id, schedule_id, CAST(sum(CASE WHEN sat_start_s IS NOT NULL THEN priority ELSE 0 END) AS BIGINT) AS profit, sum(priority) AS possible,
   avg(CASE WHEN sat_start_s IS NOT NULL THEN 1 ELSE 0 END) AS completion, avg(coalesce(sat_start_s, 3600)::DOUBLE / 3600) AS delay, sum(duration_s) AS required_s
   FROM runs JOIN task USING (scenario_id) LEFT JOIN last USING (scenario_id, schedule_id, task_id) GROUP BY ALL),
 busy AS (SELECT scenario_id, schedule_id, satellite_id, coalesce(sum(sat_end_s - sat_start_s), 0) AS b FROM (SELECT * FROM runs, (SELECT satellite_id FROM satellite)) LEFT JOIN assignment USING (scenario_id, schedule_id, satellite_id) GROUP BY ALL),
 off AS (SELECT scenario_id, schedule_id, sum(abs(b - m)) AS off FROM (SELECT *, avg(b) OVER (PARTITION BY scenario_id, schedule_id) AS m FROM busy) GROUP BY ALL),
 met AS (SELECT *, greatest(least(1 - off / (2 * required_s), 1), 0) AS balance FROM per JOIN off USING (scenario_id, schedule_id)),
 fin AS (SELECT scenario_id, schedule_id, profit, round(completion, 6) AS completion, round(delay, 6) AS delay, round(balance, 6) AS balance,
   round(0.4::DOUBLE * profit / possible + 0.3::DOUBLE * completion + 0.2::DOUBLE * greatest(1 - delay, 0) + 0.1::DOUBLE * balance, 6) AS score FROM met)"""

QUERIES = {
    "schedule_audit": (
        schedule_audit,
        BOUND + "," + _POSED + "," + _USE + f""", pr AS (SELECT a.scenario_id, a.schedule_id, a.sat_end_s, b.sat_start_s AS s, a.maneuverability AS m, abs(b.roll0 - a.roll1) + abs(b.pitch0 - a.pitch1) AS g
          FROM posed a JOIN posed b ON a.scenario_id = b.scenario_id AND a.schedule_id = b.schedule_id AND a.satellite_id = b.satellite_id AND (b.sat_start_s, b.task_id) > (a.sat_start_s, a.task_id))
        SELECT scenario_id, schedule_id, kind, count(*) AS violations FROM (
          SELECT scenario_id, schedule_id, CASE WHEN s < sat_end_s THEN 'satellite_overlap' ELSE 'transition' END AS kind FROM pr WHERE s < sat_end_s OR sat_end_s + {_TURN.format(m='m', g='g')} > s
          UNION ALL SELECT scenario_id, schedule_id, 'storage' FROM usage WHERE storage_over UNION ALL SELECT scenario_id, schedule_id, 'power' FROM usage WHERE power_over
          UNION ALL SELECT scenario_id, schedule_id, 'duration' FROM assignment WHERE sat_end_s - sat_start_s <> duration_s
          UNION ALL SELECT scenario_id, schedule_id, 'repeated_task' FROM (SELECT scenario_id, schedule_id, task_id FROM assignment GROUP BY ALL HAVING count(*) > 1)) GROUP BY ALL""",
    ),
    "schedule_neighbour_clashes": (
        schedule_neighbour_clashes,
        BOUND + "," + _POSED + f""", n AS (SELECT *, lag(sat_end_s) OVER w AS e, abs(roll0 - lag(roll1) OVER w) + abs(pitch0 - lag(pitch1) OVER w) AS g FROM posed
          WINDOW w AS (PARTITION BY scenario_id, schedule_id, satellite_id ORDER BY sat_start_s, task_id))
        SELECT scenario_id, schedule_id, count(*) AS clashes FROM n WHERE e IS NOT NULL AND e + {_TURN.format(m='maneuverability', g='g')} > sat_start_s GROUP BY ALL""",
    ),
    "schedule_evaluation": (schedule_evaluation, BOUND + "," + _METRICS + " SELECT * FROM fin"),
    "unassigned_tasks": (
        unassigned_tasks,
        BOUND + """ SELECT scenario_id, schedule_id, task_id, priority FROM (SELECT DISTINCT scenario_id, schedule_id FROM assignment) JOIN task USING (scenario_id)
        ANTI JOIN assignment USING (scenario_id, schedule_id, task_id)""",
    ),
    "orbit_capacity": (orbit_capacity, BOUND + "," + _USE + " SELECT scenario_id, schedule_id, satellite_id, orbit_number, round(storage_gb * 8192, 4) AS storage_mbit, round(power_w, 4) AS power_w, storage_over, power_over FROM usage"),
    "profit_variance": (
        profit_variance,
        BOUND + """ SELECT scenario_id, count(*) AS runs, round(avg(p), 6) AS mean_profit, round(CASE WHEN count(*) >= 2 THEN var_samp(p) END, 4) AS profit_variance
        FROM (SELECT scenario_id, schedule_id, sum(priority) AS p FROM assignment GROUP BY ALL) GROUP BY scenario_id""",
    ),
    "penalty_objective": (
        penalty_objective,
        BOUND + """ SELECT scenario_id, schedule_id, CAST(p - 2 * (n - k) AS BIGINT) AS objective FROM (SELECT scenario_id, schedule_id, sum(priority) AS p, count(DISTINCT task_id) AS k FROM assignment GROUP BY ALL)
        JOIN (SELECT scenario_id, count(*) AS n FROM task GROUP BY ALL) USING (scenario_id)""",
    ),
    "satellite_load": (
        satellite_load,
        BOUND + """ SELECT scenario_id, schedule_id, round(avg(n), 6) AS load_mean, round(stddev_pop(n), 6) AS load_std FROM (
          SELECT scenario_id, schedule_id, satellite_id, count(task_id) AS n FROM (SELECT DISTINCT scenario_id, schedule_id, s.satellite_id FROM assignment, satellite s)
          LEFT JOIN assignment USING (scenario_id, schedule_id, satellite_id) GROUP BY ALL) GROUP BY ALL""",
    ),
    "gantt_bars": (
        gantt_bars,
        BOUND + """ SELECT scenario_id, schedule_id, task_id, round(100.0::DOUBLE * (sat_start_s - lo) / greatest(hi - lo, 1), 4) AS offset_pct, round(100.0::DOUBLE * (sat_end_s - sat_start_s) / greatest(hi - lo, 1), 4) AS width_pct
        FROM (SELECT *, min(sat_start_s) OVER (PARTITION BY scenario_id, schedule_id) AS lo, max(sat_end_s) OVER (PARTITION BY scenario_id, schedule_id) AS hi FROM assignment)""",
    ),
    "active_at": (
        active_at,
        BOUND + """ SELECT scenario_id, schedule_id, satellite_id, task_id, CAST(row_number() OVER (PARTITION BY scenario_id, schedule_id, satellite_id ORDER BY sat_start_s, task_id) AS INTEGER) AS place
        FROM assignment WHERE sat_start_s <= 1800 AND sat_end_s > 1800""",
    ),
    "algorithm_comparison": (
        algorithm_comparison,
        BOUND + "," + _METRICS + ", r AS (SELECT scenario_id, schedule_id, round(profit::DOUBLE / max(profit) OVER w, 6) AS p, round(score / max(score) OVER w, 6) AS s FROM fin WINDOW w AS (PARTITION BY scenario_id)) SELECT scenario_id, "
        + ", ".join(f"max(p) FILTER (schedule_id = '{n}') AS {n}_profit, max(s) FILTER (schedule_id = '{n}') AS {n}_score" for n in ("earliest", "longest", "returned"))
        + " FROM r GROUP BY scenario_id",
    ),
    "job_matrix": (
        job_matrix,
        BOUND + """ SELECT scenario_id, algorithm, CASE WHEN weighted THEN objective ELSE 'implicit' END AS objective, CASE WHEN weighted THEN weight ELSE 1.0 END AS weight
        FROM (SELECT scenario_id, count(DISTINCT satellite_id) AS n FROM task_window GROUP BY ALL),
          (VALUES ('mip', true), ('sa', true), ('ga', true), ('profit_first', false), ('balance_first', false)) a(algorithm, weighted),
          (VALUES ('profit', 1.0::DOUBLE), ('mixed', 0.25::DOUBLE)) w(objective, weight) WHERE (weighted OR objective = 'profit') AND (algorithm <> 'mip' OR n <= 20)""",
    ),
}
