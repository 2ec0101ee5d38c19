"""Candidate placements of tasks in observation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.functions.exprs import data_volume_gb
from orbweave.tables import BOUND, Scenarios

CAP = 64


def place(start: Column, end: Column, duration: Column, mode: str = "earliest") -> Column:
    """Start of a duration within a window, null where it does not fit; unknown modes mean earliest."""
    slack = end - start - duration
    at = {"center": start + F.floor(slack / 2), "latest": end - duration}.get(mode, start)
    return F.when(slack >= 0, at)


def attitude(seed: Column, satellite: Column, k: Column) -> list[Column]:
    """Roll and pitch of a window's sample k under the test binding."""
    return [(seed + 3 * k) % 91 - 45, (7 * satellite + 2 * k) % 91 - 45]


def enumerate_candidates(task_window: DataFrame, task: DataFrame, satellite: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per window and offset that fits (C02, C03, C04): k, c_start_s, c_end_s, place_rank within the task.

    Agile satellites, and those that the satellite table does not have, may start at every step, others only at the middle
    one; without a known sensor volume and power are 0 (B13). Order within a task: windows by time and
    identity, then first, centre and last offset, then ascending; cap keeps that many of each task before any
    feasibility test.
    """
    return offsets_of(windows_of(task_window.join(task, ["scenario_id", "task_id"]), satellite, cap))


def windows_of(rows: DataFrame, satellite: DataFrame, cap: int | None = None, dealt: list[str] | tuple = ()) -> DataFrame:
    """The windows of enumerate_candidates() with ks, their offsets in canonical order, and before, the number of candidates
    of the task in the windows before them. A cap keeps what can hold the first candidates of a task.

    rows: windows with their tasks. dealt: columns that they are dealt by and that follow from the task. Windows are sorted within a task, candidates never: those of a window stand together.
    """
    max_k = F.floor((F.col("end_s") - F.col("start_s") - F.col("duration_s") + 1e-9) / F.col("step_s")).cast("long")
    rows = (
        rows.join(satellite.select("satellite_id", "maneuverability", "data_rate_mbps", "power_w"), "satellite_id", "left")
        .withColumns({"max_k": max_k, "maneuverability": F.coalesce("maneuverability", F.lit("agile"))})
        .where("max_k >= 0")
    )
    middle, last = F.bround(F.col("max_k") / 2).cast("long"), F.col("max_k")
    fixed = F.col("maneuverability") == "non_agile"
    first = F.array(F.lit(0).cast("long"), middle, last)
    end = last if cap is None else F.least(last, F.lit(cap - 1).cast("long"))  # the offsets beyond never count
    ks = F.array_distinct(F.concat(first, F.sequence(F.lit(0).cast("long"), end)))
    n = F.when(fixed, 1).otherwise(last + 1)
    order = Window.partitionBy(*dealt, "scenario_id", "task_id").orderBy("start_s", "end_s", "satellite_id", "orbit_number", "window_id")
    rows = rows.withColumn("before", F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if cap is not None:
        rows = rows.where(F.col("before") < cap)
        ks = F.slice(ks, F.lit(1), (cap - F.col("before")).cast("int"))
    return rows.withColumn("ks", F.when(fixed, F.array(middle)).otherwise(ks)).drop("max_k")


def offsets_of(windows: DataFrame, dealt: list[str] | tuple = ()) -> DataFrame:
    """The candidates of windows_of(): a row for each offset."""
    return listed(windows).select(
        *dealt, "scenario_id", "task_id", "satellite_id", "window_id", "orbit_number", "priority", "duration_s", "maneuverability", "k", "place_rank", "seed",
        "c_start_s", "c_end_s",
        data_volume_gb(F.col("data_rate_mbps"), F.col("duration_s")).alias("data_volume_gb"), F.coalesce("power_w", F.lit(0.0)).alias("power_w"),
    )


def listed(windows: DataFrame) -> DataFrame:
    """windows_of() by offset, with all their columns: k, place_rank, c_start_s, c_end_s."""
    names = [c for c in windows.columns if c not in ("ks", "before")]
    rows = windows.select(*names, "before", F.posexplode("ks").alias("pos", "k"))
    c_start = F.col("start_s") + F.col("k") * F.col("step_s")
    return rows.select(*names, "k", (F.col("before") + F.col("pos") + 1).cast("int").alias("place_rank"), c_start.alias("c_start_s"), (c_start + F.col("duration_s")).alias("c_end_s"))


def downlink_pairs(candidates: DataFrame, comm_window: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Candidates with each distinct downlink placement that fits after them (C05): earliest, centre and latest."""
    c, w = candidates, comm_window.select("satellite_id", "comm_id", "station_id", F.col("start_s").alias("g0"), F.col("end_s").alias("g1"))
    need = F.col("duration_s") * ratio
    begin = F.greatest("g0", "c_end_s")
    slack = F.col("g1") - begin - need
    return (
        c.join(w, "satellite_id")
        .where(slack >= 0)
        .withColumn("gs_start_s", F.explode(F.array_distinct(F.array(begin, (begin + F.floor(slack / 2)).cast("long"), (F.col("g1") - need).cast("long")))))
        .withColumn("gs_end_s", F.col("gs_start_s") + need.cast("long"))
        .drop("g0", "g1")
    )


def candidates_of(t: Scenarios, cap: int | None = None) -> DataFrame:
    return offsets_of(windows_of(t.placed_window, t.satellite, cap))


CANDIDATE_SQL = """candidate AS (
  SELECT *, start_s + k * step_s AS c_start_s, start_s + k * step_s + duration_s AS c_end_s,
    data_rate_mbps * duration_s / (8 * 1024) AS data_volume_gb,
    row_number() OVER (PARTITION BY scenario_id, task_id ORDER BY start_s, end_s, satellite_id, orbit_number, window_id,
      CASE WHEN k = 0 THEN 0 WHEN k = mid THEN 1 WHEN k = max_k THEN 2 ELSE 3 END, k) AS place_rank
  FROM (
    SELECT *, unnest(CASE WHEN maneuverability = 'non_agile' THEN [mid] ELSE range(0, max_k + 1) END) AS k FROM (
      SELECT *, CAST(round_even(max_k / 2, 0) AS BIGINT) AS mid FROM (
        SELECT w.*, priority, duration_s, maneuverability, data_rate_mbps, power_w,
          CAST(floor((end_s - start_s - duration_s + 1e-9) / step_s) AS BIGINT) AS max_k
        FROM task_window w JOIN task USING (scenario_id, task_id) JOIN satellite USING (satellite_id)) WHERE max_k >= 0)))"""


def candidate_counts(t: Scenarios) -> DataFrame:
    """scenario_id, satellite_id, task_id, n, gb: candidates of each window and their volume, counted without listing them."""
    max_k = F.floor((F.col("end_s") - F.col("start_s") - F.col("duration_s") + 1e-9) / F.col("step_s")).cast("long")
    n = F.when(F.col("maneuverability").eqNullSafe("non_agile"), F.lit(1).cast("long")).otherwise(max_k + 1)
    rows = t.window_row.join(t.task, ["scenario_id", "task_id"]).join(t.satellite, "satellite_id", "left").where(max_k >= 0)
    return rows.select("scenario_id", "satellite_id", "task_id", n.alias("n"), (n * data_volume_gb(F.col("data_rate_mbps"), F.col("duration_s"))).alias("gb"))


def candidate_statistics(spark, sf_dir: str) -> DataFrame:
    """Per scenario: candidates enumerated, kept under the cap, tasks that reached it."""
    all_of = candidate_counts(Scenarios(spark, sf_dir)).groupBy("scenario_id", "task_id").agg(F.sum("n").alias("n"), F.sum("gb").alias("gb"))
    return all_of.groupBy("scenario_id").agg(
        F.sum("n").alias("enumerated"),
        F.sum(F.least("n", F.lit(CAP))).alias("kept"),
        F.count_if(F.col("n") > CAP).alias("tasks_capped"),
        F.round(F.sum("gb"), 6).alias("total_gb"),
    )


def capped_candidates(spark, sf_dir: str) -> DataFrame:
    """The first three candidates of each task in canonical order."""
    c = candidates_of(Scenarios(spark, sf_dir), 3)
    return c.select("scenario_id", "task_id", "place_rank", "window_id", "k", "c_start_s", "c_end_s")


def window_placements(spark, sf_dir: str) -> DataFrame:
    """Earliest, centre and latest start of each task in each of its windows, null where it does not fit."""
    t = Scenarios(spark, sf_dir)
    w = t.task_window.join(t.task, ["scenario_id", "task_id"])
    modes = [place(F.col("start_s"), F.col("end_s"), F.col("duration_s"), m).alias(m) for m in ("earliest", "center", "latest")]
    return w.select("scenario_id", "window_id", *modes)


def task_opportunity(spark, sf_dir: str) -> DataFrame:
    """Per scenario: mean candidates of a task, share of tasks with two at most, tasks without any counted."""
    t = Scenarios(spark, sf_dir)
    n = candidate_counts(t).groupBy("scenario_id", "task_id").agg(F.sum("n").alias("n"))
    per = t.task.join(n, ["scenario_id", "task_id"], "left").select("scenario_id", F.coalesce("n", F.lit(0)).alias("n"))
    return per.groupBy("scenario_id").agg(
        F.count("*").alias("tasks"), F.round(F.avg("n"), 6).alias("mean_candidates"), F.round(F.avg((F.col("n") <= 2).cast("double")), 6).alias("scarce_share")
    )


def downlink_options(spark, sf_dir: str) -> DataFrame:
    """Per scenario and satellite: candidates with a downlink, and their placements."""
    t = Scenarios(spark, sf_dir)
    return placements_by_satellite(windows_of(t.placed_window, t.satellite), t.comm_window)


def placements_by_satellite(windows: DataFrame, comm_window: DataFrame) -> DataFrame:
    """Per scenario and satellite, what downlink_pairs() lists for the candidates of windows_of(): windows, placements and the
    sum of their starts. A contact that starts after a window's last candidate ends serves all of them alike, so it is
    counted once; offsets are listed only for contacts that start before."""
    w = windows.select("scenario_id", "satellite_id", "window_id", "duration_s", "step_s", "ks", (F.col("start_s") + F.col("duration_s")).alias("first_s"))
    w = w.withColumns({"low": F.col("first_s") + F.array_min("ks") * F.col("step_s"), "high": F.col("first_s") + F.array_max("ks") * F.col("step_s")})
    g = comm_window.select("satellite_id", F.col("start_s").alias("g0"), F.col("end_s").alias("g1"))
    pairs = w.join(g, "satellite_id").where(F.col("g1") - F.greatest("g0", "low") >= F.col("duration_s"))
    ends = F.when(F.col("high") <= F.col("g0"), F.array(F.struct(F.size("ks").cast("long").alias("n"), F.col("g0").alias("begin"))))
    ends = ends.otherwise(F.transform("ks", lambda k: F.struct(F.lit(1).cast("long").alias("n"), F.greatest(F.col("g0"), F.col("first_s") + k * F.col("step_s")).alias("begin"))))
    rows = pairs.select("scenario_id", "satellite_id", "window_id", "g1", "duration_s", F.inline(ends)).withColumn("slack", F.col("g1") - F.col("begin") - F.col("duration_s")).where("slack >= 0")
    half = F.col("slack") > 1  # the centre is neither the earliest nor the latest
    count = 1 + half.cast("long") + (F.col("slack") > 0).cast("long")
    total = F.col("begin") + F.when(half, F.col("begin") + F.floor(F.col("slack") / 2)).otherwise(0) + F.when(F.col("slack") > 0, F.col("begin") + F.col("slack")).otherwise(0)
    each = rows.groupBy("scenario_id", "satellite_id", "window_id").agg(F.sum(F.col("n") * count).alias("placements"), F.sum(F.col("n") * total).alias("start_sum"))
    return each.groupBy("scenario_id", "satellite_id").agg(F.count("window_id").alias("windows"), F.sum("placements").alias("placements"), F.sum("start_sum").alias("start_sum"))


QUERIES = {
    "candidate_statistics": (
        candidate_statistics,
        BOUND + "," + CANDIDATE_SQL + f""" SELECT scenario_id, CAST(sum(n) AS BIGINT) AS enumerated, CAST(sum(least(n, {CAP})) AS BIGINT) AS kept,
        count(*) FILTER (n > {CAP}) AS tasks_capped, round(sum(gb), 6) AS total_gb
        FROM (SELECT scenario_id, task_id, count(*) AS n, sum(data_volume_gb) AS gb FROM candidate GROUP BY ALL) GROUP BY scenario_id""",
    ),
    "capped_candidates": (
        capped_candidates,
        BOUND + "," + CANDIDATE_SQL + " SELECT scenario_id, task_id, CAST(place_rank AS INTEGER) AS place_rank, window_id, k, c_start_s, c_end_s FROM candidate WHERE place_rank <= 3",
    ),
    "window_placements": (
        window_placements,
        BOUND + """ SELECT scenario_id, window_id, CASE WHEN s >= 0 THEN start_s END AS earliest,
        CASE WHEN s >= 0 THEN start_s + s // 2 END AS center, CASE WHEN s >= 0 THEN end_s - duration_s END AS latest
        FROM (SELECT *, end_s - start_s - duration_s AS s FROM task_window JOIN task USING (scenario_id, task_id))""",
    ),
    "task_opportunity": (
        task_opportunity,
        BOUND + "," + CANDIDATE_SQL + """ SELECT scenario_id, count(*) AS tasks, round(avg(coalesce(n, 0)), 6) AS mean_candidates,
        round(avg(CASE WHEN coalesce(n, 0) <= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS scarce_share
        FROM task LEFT JOIN (SELECT scenario_id, task_id, count(*) AS n FROM candidate GROUP BY ALL) USING (scenario_id, task_id) GROUP BY scenario_id""",
    ),
    "downlink_options": (
        downlink_options,
        BOUND + "," + CANDIDATE_SQL + """ SELECT scenario_id, satellite_id, count(DISTINCT window_id) AS windows, count(*) AS placements, CAST(sum(g) AS BIGINT) AS start_sum
        FROM (SELECT scenario_id, satellite_id, window_id, unnest(list_distinct([b, b + s // 2, b + s])) AS g
          FROM (SELECT c.*, greatest(m.start_s, c_end_s) AS b, m.end_s - greatest(m.start_s, c_end_s) - duration_s AS s
                FROM candidate c JOIN comm_window m USING (satellite_id)) WHERE s >= 0) GROUP BY ALL""",
    ),
}
