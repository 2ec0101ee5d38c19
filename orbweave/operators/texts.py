"""Queries of scalar functions: times, names, paths, hashes, transitions, orbits, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.functions import exprs
from orbweave.functions.attitudes import NAMES, attitude_of
from orbweave.plans.range_join import follows_within
from orbweave.sources.files import format_run_log
from orbweave.tables import BOUND, Scenarios


def transition_times(spark, sf_dir: str) -> DataFrame:
    """Transition seconds under each profile for a change made of part sizes."""
    p = Scenarios(spark, sf_dir).raw("part")
    change = (F.col("p_size") * 3.7).cast("double")
    cols = [F.round(exprs.transition_s(change, name), 4).alias(name.split("-")[0].lower()) for name in exprs.PROFILES]
    agile = F.col("p_partkey") % 5 != 0
    return p.select("p_partkey", *cols, F.round(exprs.transition_s(change, agile=agile), 4).alias("mixed"))


def orbit_numbers(spark, sf_dir: str) -> DataFrame:
    """Orbital period of a semi-major axis and the orbit at a time, and range violations by class."""
    p = Scenarios(spark, sf_dir).raw("part")
    a = (F.col("p_size") * 250 + 6500).cast("double")
    period = exprs.orbital_period_s(a)
    kind = F.get(F.array(*map(F.lit, ("LEO", "MEO", "GEO", "HEO"))), (F.col("p_partkey") % 4).cast("int"))
    return p.select(
        "p_partkey", F.round(period, 4).alias("period_s"), exprs.orbit_number(F.col("p_partkey") * 10 - 50, period).alias("orbit"), kind.alias("class"),
        exprs.axis_out_of_range(kind, a).alias("out_of_range"),
    )


def path_groups(spark, sf_dir: str) -> DataFrame:
    """Paths made of suppliers grouped by their template (B25), with safe names."""
    s = Scenarios(spark, sf_dir).raw("supplier")
    text = lambda c: F.col(c).cast("string")
    path = F.concat(
        F.lit("Out\\\\a//X_p"), text("s_nationkey"), F.lit("_cities_0"), text("s_nationkey"), F.lit("_Seed"), text("s_suppkey"), F.lit("_sf7_S"), text("s_suppkey"),
        F.when(F.col("s_suppkey") % 2 == 0, ".json").otherwise(""),
    )
    return s.groupBy(exprs.path_template(path).alias("template"), exprs.safe_file_name(F.col("s_name")).alias("name")).agg(F.count("*").alias("n"))


def event_labels(spark, sf_dir: str) -> DataFrame:
    """Fields of JSON properties with null-or-zero defaults, and written times read back."""
    e = Scenarios(spark, sf_dir).raw("events")
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.date_format("ts", "dd MMM yyyy HH:mm:ss")
    return e.select("event_id", exprs.either(k % 10, -1).alias("k"), F.unix_timestamp(exprs.any_epoch(text)).alias("at_s"))


def log_lines(spark, sf_dir: str) -> DataFrame:
    """A fixed-width report line for each supplier."""
    s = Scenarios(spark, sf_dir).raw("supplier").select("s_name", "s_acctbal")
    return format_run_log(s, {"s_name": 12, "s_acctbal": 12})


def visible_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of visible samples: from the first visible one to the first that is not, or the end of all."""
    s = Scenarios(spark, sf_dir).sample
    by = Window.partitionBy("resource_id").orderBy("ts_s")
    end = F.max("ts_s").over(Window.partitionBy("resource_id"))
    s = s.withColumns({"new": (F.col("visible") != F.coalesce(F.lag("visible").over(by), ~F.col("visible"))).cast("int"), "next_s": F.coalesce(F.lead("ts_s").over(by), end)})
    s = s.withColumn("run", F.sum("new").over(by)).where("visible")
    return s.groupBy("resource_id", "run").agg(F.min("ts_s").alias("start_s"), F.max("next_s").alias("end_s"), F.count("*").alias("samples")).drop("run")


def window_samples(spark, sf_dir: str) -> DataFrame:
    """Samples inside each contact: count, first and middle one (F03, B21); contacts without any are left out."""
    t = Scenarios(spark, sf_dir)
    w = t.comm_window.select(F.col("station_id").alias("k"), "comm_id", F.col("start_s").alias("at_s"), "end_s")
    s = t.sample.select((F.col("resource_id") % 5).alias("k"), (F.col("ts_s") % 3600).alias("at_s"))
    inside = span_samples(w.select("k", "at_s", "end_s").distinct(), s)
    return w.join(inside, ["k", "at_s", "end_s"]).select("comm_id", F.col("samples").cast("int").alias("samples"), "first_s", "middle_s")


def span_samples(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """spans (k, at_s, end_s; distinct) with the samples (k, at_s) inside: their number, the first and the middle one.

    Samples of one key and second are one row with their number, so a span meets no more rows than it has seconds.
    """
    seconds = samples.groupBy("k", "at_s").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("at_s"))  # a row for each second of a key
    seconds = seconds.withColumn("upto", upto)
    inside = follows_within(spans, seconds, ["k"], "at_s", F.col("end_s") - F.col("at_s"), 90)
    g = inside.groupBy("k", "at_s", "end_s").agg(
        F.sum("r_n").alias("samples"), F.min("r_at_s").alias("first_s"), F.min(F.col("r_upto") - F.col("r_n")).alias("before"),
        F.array_sort(F.collect_list(F.struct("r_at_s", "r_upto"))).alias("x"),
    )
    middle = F.col("before") + F.floor(F.col("samples") / 2)
    return g.select("k", "at_s", "end_s", "samples", "first_s", F.get(F.filter("x", lambda s: s["r_upto"] > middle), F.lit(0))["r_at_s"].alias("middle_s"))


def visible_samples_attitude(spark, sf_dir: str) -> DataFrame:
    """Attitude at the middle of each window: index by half-even rounding, clipped."""
    w = Scenarios(spark, sf_dir).task_window
    n = F.floor((F.col("end_s") - F.col("start_s")) / F.col("step_s"))
    series = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: (F.col("seed") + 3 * k) % 91 - 45)
    at = F.least(F.greatest(F.bround((F.col("end_s") - F.col("start_s")) / 2 / F.col("step_s")).cast("long"), F.lit(0)), n)
    return w.select("scenario_id", "window_id", F.element_at(series, (at + 1).cast("int")).alias("roll"), F.size(F.slice(series, (at + 1).cast("int"), 3)).alias("rest"))


_T = "round(CASE WHEN g <= 10 THEN 11.66 WHEN g <= 30 THEN 5 + g / {0} WHEN g <= 60 THEN 10 + g / {1} WHEN g <= 90 THEN 16 + g / {2} ELSE 22 + g / {3} END, 4) AS {4}"

def angle_containers(task_window: DataFrame) -> DataFrame:
    """scenario_id, window_id and angles, a JSON text: the attitudes of a window's two to four samples in one of eight shapes,
    by window_id; the last shape is one that holds no attitude."""
    ks = F.sequence(F.lit(0).cast("long"), F.col("seed") % 3 + 1)
    at = lambda k: [(F.col("seed") + 3 * k) % 91 - 45, (7 * F.col("satellite_id") + 2 * k) % 91 - 45, k]
    record = lambda names, k: F.struct(*[v.alias(n) for n, v in zip(names, at(k))])
    samples = [F.transform(ks, lambda k: at(k)[0]), F.transform(ks, lambda k: at(k)[1]), ks]
    listed = lambda names: F.struct(*[c.alias(n) for n, c in zip(names, samples)])
    zero = F.lit(0).cast("long")
    shapes = [
        F.transform(ks, lambda k: record(NAMES[0], k)), F.transform(ks, lambda k: record(NAMES[1], k)), F.transform(ks, lambda k: F.array(*at(k))), listed(NAMES[0]), listed(NAMES[1]),
        record(NAMES[2], zero), F.struct(F.lit("x").alias("source"), record(NAMES[0], zero).alias("attitude")), record(NAMES[0], zero),
    ]
    text = F.coalesce(*[F.when(F.col("window_id") % len(shapes) == i, F.to_json(c)) for i, c in enumerate(shapes)])
    return task_window.select("scenario_id", "window_id", text.alias("angles"))


def container_attitudes(spark, sf_dir: str) -> DataFrame:
    """Roll, pitch and yaw at the first and last sample of each window's container."""
    rows = angle_containers(Scenarios(spark, sf_dir).task_window).withColumn("v", F.try_parse_json("angles"))
    rows = rows.withColumns({"first": attitude_of(F.col("v")), "last": attitude_of(F.col("v"), last=True)})
    return rows.select("scenario_id", "window_id", *[F.col(f"{e}.{n}").cast("long").alias(f"{n}_{e}") for e in ("first", "last") for n in NAMES[0]])


QUERIES = {
    "transition_times": (
        transition_times,
        "SELECT p_partkey, " + ", ".join(_T.format(*[f"{v}::DOUBLE" for v in vs], name.split("-")[0].lower()) for name, vs in exprs.PROFILES.items())
        + ", CASE WHEN p_partkey % 5 = 0 THEN 10.0::DOUBLE ELSE " + _T.format("1.5::DOUBLE", "2.0::DOUBLE", "2.5::DOUBLE", "3.0::DOUBLE", "x").removesuffix(" AS x")
        + " END AS mixed FROM (SELECT *, CAST(p_size * 3.7::DOUBLE AS DOUBLE) AS g FROM part)",
    ),
    "orbit_numbers": (
        orbit_numbers,
        """SELECT p_partkey, round(t, 4) AS period_s, CAST(floor(greatest(p_partkey * 10 - 50, 0) / t) + 1 AS BIGINT) AS orbit, CASE p_partkey % 4 WHEN 0 THEN 'LEO' WHEN 1 THEN 'MEO' WHEN 2 THEN 'GEO' ELSE 'HEO' END AS class,
        CASE p_partkey % 4 WHEN 0 THEN NOT a BETWEEN 6378 AND 9000 WHEN 1 THEN NOT (a > 9000 AND a <= 30000) WHEN 2 THEN NOT a BETWEEN 40000 AND 45000 ELSE false END AS out_of_range
        FROM (SELECT *, 2 * pi() * sqrt(pow(a, 3) / 398600.4418::DOUBLE) AS t FROM (SELECT *, CAST(p_size * 250 + 6500 AS DOUBLE) AS a FROM part))""",
    ),
    "path_groups": (
        path_groups,
        r"""SELECT lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '_p\d+_', '_p_', 'g'), '_cities_\d+_', '_cities_', 'g'),
          '_[Ss]eed\d+_', '_seed_', 'g'), '_sf\d+_', '_sf_', 'g'), '_S\d+_', '_S_', 'g'), '_S\d+(\.|$)', '_S\1')) AS template,
          regexp_replace(s_name, '[^A-Za-z0-9._-]+', '_', 'g') AS name, count(*) AS n
        FROM (SELECT *, 'Out/a/X_p' || s_nationkey || '_cities_0' || s_nationkey || '_Seed' || s_suppkey || '_sf7_S' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.json' ELSE '' END AS path FROM supplier)
        GROUP BY ALL""",
    ),
    "event_labels": (
        event_labels,
        """SELECT event_id, coalesce(nullif(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10, 0), -1) AS k, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_s FROM events""",
    ),
    "log_lines": (
        log_lines,
        """SELECT rpad(CASE WHEN length(s_name) > 12 THEN substr(s_name, 1, 9) || '...' ELSE s_name END, 12, ' ') || ' | ' || rpad(printf('%.3f', s_acctbal), 12, ' ') AS line FROM supplier""",
    ),
    "visible_runs": (
        visible_runs,
        BOUND + """, a AS (SELECT *, CASE WHEN visible IS DISTINCT FROM lag(visible) OVER w THEN 1 ELSE 0 END AS nw, coalesce(lead(ts_s) OVER w, max(ts_s) OVER (PARTITION BY resource_id)) AS nx FROM sample WINDOW w AS (PARTITION BY resource_id ORDER BY ts_s)),
        b AS (SELECT *, sum(nw) OVER (PARTITION BY resource_id ORDER BY ts_s) AS r FROM a)
        SELECT resource_id, min(ts_s) AS start_s, max(nx) AS end_s, count(*) AS samples FROM b WHERE visible GROUP BY resource_id, r""",
    ),
    "window_samples": (
        window_samples,
        BOUND + """ SELECT comm_id, CAST(len(x) AS INTEGER) AS samples, x[1] AS first_s, x[len(x) // 2 + 1] AS middle_s FROM (
        SELECT comm_id, list(t ORDER BY t) AS x FROM comm_window JOIN (SELECT resource_id % 5 AS k, ts_s % 3600 AS t FROM sample) ON k = station_id AND t >= start_s AND t < end_s GROUP BY comm_id)""",
    ),
    "visible_samples_attitude": (
        visible_samples_attitude,
        BOUND + """ SELECT scenario_id, window_id, (seed + 3 * i) % 91 - 45 AS roll, CAST(least(n - i + 1, 3) AS INTEGER) AS rest FROM (
        SELECT *, least(greatest(CAST(round_even((end_s - start_s) / 2 / step_s, 0) AS BIGINT), 0), (end_s - start_s) // step_s) AS i, (end_s - start_s) // step_s AS n FROM task_window)""",
    ),
    "container_attitudes": (
        container_attitudes,
        BOUND + """, s AS (SELECT *, window_id % 8 AS shape, CASE WHEN window_id % 8 < 5 THEN seed % 3 + 1 ELSE 0 END AS k FROM task_window)
        SELECT scenario_id, window_id, CASE WHEN shape < 7 THEN seed % 91 - 45 END AS roll_first, CASE WHEN shape < 7 THEN (7 * satellite_id) % 91 - 45 END AS pitch_first, CASE WHEN shape < 7 THEN 0 END AS yaw_first,
          CASE WHEN shape < 7 THEN (seed + 3 * k) % 91 - 45 END AS roll_last, CASE WHEN shape < 7 THEN (7 * satellite_id + 2 * k) % 91 - 45 END AS pitch_last, CASE WHEN shape < 7 THEN k END AS yaw_last FROM s""",
    ),
}
