"""Building training sets: coverage, sub-samples, capacities, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.plans.ordering import ranked
from orbweave.tables import BOUND, HORIZON_S, Scenarios


def normalised_weights(weights: list[Column]) -> list[Column]:
    """Weights over their sum; all zero means the first one alone."""
    total = sum(weights[1:], weights[0])
    return [F.when(total > 0, w / total).otherwise(1.0 if i == 0 else 0.0) for i, w in enumerate(weights)]


def tail_coverage(spark, sf_dir: str) -> DataFrame:
    """Mean over states of the smaller of the shares of its best and of its worst quarter that its first two actions by hash cover."""
    from orbweave.operators.catalogs import actions

    a = actions(Scenarios(spark, sf_dir))
    by = Window.partitionBy("state_id")
    n = F.count("*").over(by)
    a = a.withColumns({"best": F.row_number().over(by.orderBy(F.desc("q"), "action")), "worst": F.row_number().over(by.orderBy("q", "action")), "b": F.ceil(n / 4), "asked": F.row_number().over(by.orderBy(F.md5("action"), "action")) <= 2})
    per = a.groupBy("state_id").agg(
        F.count_if(F.col("asked") & (F.col("best") <= F.col("b"))).alias("high"), F.count_if(F.col("asked") & (F.col("worst") <= F.col("b"))).alias("low"), F.max("b").alias("b")
    )
    return per.agg(F.count("*").alias("states"), F.round(F.avg(F.least("high", "low") / F.col("b")), 6).alias("coverage"))


def sub_scenarios(spark, sf_dir: str) -> DataFrame:
    """Ten satellites and a hundred tasks of each scenario by hash order, windows clipped to half the horizon."""
    t = Scenarios(spark, sf_dir)

    def first(df: DataFrame, key: str, n: int) -> DataFrame:
        text = F.concat_ws("|", F.lit("sub"), "scenario_id", F.col(key).cast("string"))
        return df.withColumn("r", F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.md5(text), key))).where(F.col("r") <= n).select("scenario_id", key)

    sats = first(t.task_window.select("scenario_id", "satellite_id").distinct(), "satellite_id", 10)
    tasks = first(t.task.select("scenario_id", "task_id"), "task_id", 100)
    w = t.task_window.join(sats, ["scenario_id", "satellite_id"], "left_semi").join(tasks, ["scenario_id", "task_id"], "left_semi")
    return w.where(F.col("start_s") < HORIZON_S // 2).select("scenario_id", "window_id", "start_s", F.least("end_s", F.lit(HORIZON_S // 2)).alias("end_s"))


def capacity_modes(spark, sf_dir: str) -> DataFrame:
    """Capacity factors 0.6, 1 and 1.6 dealt to thirds of the satellites in hash order."""
    s = Scenarios(spark, sf_dir).satellite.withColumn("constellation", F.lit(1))
    s = ranked(s, ["constellation"], {"hash": F.md5(F.col("satellite_id").cast("string")), "id": F.col("satellite_id")}, "rank", "n")
    place, third = F.col("rank") - 1, F.floor(F.col("n") / 3)
    factor = F.when(place < third, 0.6).when(place < 2 * third, 1.0).otherwise(1.6)
    return s.select("satellite_id", factor.alias("factor"), F.round(F.col("max_power_w") * factor, 4).alias("max_power_w"))


def synthetic_targets(spark, sf_dir: str) -> DataFrame:
    """A target for each customer: place and priority from the digits of a hash, so that it never changes."""
    c = Scenarios(spark, sf_dir).raw("customer").select(F.col("c_custkey").alias("k"))
    h = F.md5(F.concat(F.lit("target|"), F.col("k").cast("string")))
    bits = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    return c.select(
        F.concat(F.lit("M"), F.lpad((F.col("k") + 1).cast("string"), 6, "0")).alias("target"),
        F.round(bits(1) / 4294967296.0 * 360 - 180, 6).alias("lon"), F.round(bits(9) / 4294967296.0 * 180 - 90, 6).alias("lat"),
        (1 + bits(17) % 10).alias("priority"), (5 + bits(25) % 11).alias("duration_s"),
    )


def scenario_grid(spark, sf_dir: str) -> DataFrame:
    """Names of all scenarios to make: nations as constellations, by mission count and days."""
    n = Scenarios(spark, sf_dir).raw("nation").select(F.col("n_nationkey").cast("long").alias("constellation"))
    grid = n.withColumn("missions", F.explode(F.array(*[F.lit(x).cast("long") for x in (100, 500)]))).withColumn("days", F.explode(F.array(F.lit(0.5), F.lit(1.0))))
    number = F.row_number().over(Window.orderBy("constellation", "missions", "days"))  # a grid of settings
    return grid.select(F.format_string("scenario_%04d_M%d", number, F.col("missions")).alias("name"), "constellation", "missions", "days")


QUERIES = {
    "tail_coverage": (
        tail_coverage,
        """WITH a AS (SELECT l_orderkey AS s, l_partkey || '|' || l_suppkey AS action, max(l_extendedprice) AS q FROM lineitem GROUP BY ALL),
        r AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY q DESC, action) AS best, row_number() OVER (PARTITION BY s ORDER BY q, action) AS worst, ceil(count(*) OVER (PARTITION BY s) / 4) AS b,
          row_number() OVER (PARTITION BY s ORDER BY md5(action), action) <= 2 AS asked FROM a)
        SELECT count(*) AS states, round(avg(least(h, l) / b), 6) AS coverage FROM (SELECT s, count(*) FILTER (asked AND best <= b) AS h, count(*) FILTER (asked AND worst <= b) AS l, max(b) AS b FROM r GROUP BY s)""",
    ),
    "sub_scenarios": (
        sub_scenarios,
        BOUND + """, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY md5('sub|' || scenario_id || '|' || satellite_id), satellite_id) AS r FROM (SELECT DISTINCT scenario_id, satellite_id FROM task_window)) WHERE r <= 10),
        k AS (SELECT * FROM (SELECT scenario_id, task_id, row_number() OVER (PARTITION BY scenario_id ORDER BY md5('sub|' || scenario_id || '|' || task_id), task_id) AS r FROM task) WHERE r <= 100)
        SELECT scenario_id, window_id, start_s, least(end_s, 1800) AS end_s FROM task_window SEMI JOIN s USING (scenario_id, satellite_id) SEMI JOIN k USING (scenario_id, task_id) WHERE start_s < 1800""",
    ),
    "capacity_modes": (
        capacity_modes,
        """SELECT satellite_id, factor, round(600::DOUBLE * factor, 4) AS max_power_w FROM (SELECT s_suppkey AS satellite_id, CAST(CASE WHEN p < n // 3 THEN 0.6 WHEN p < 2 * (n // 3) THEN 1.0 ELSE 1.6 END AS DOUBLE) AS factor
        FROM (SELECT s_suppkey, row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS p, count(*) OVER () AS n FROM supplier))""",
    ),
    "synthetic_targets": (
        synthetic_targets,
        """SELECT 'M' || lpad(CAST(k + 1 AS VARCHAR), 6, '0') AS target, round(CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 360 - 180, 6) AS lon, round(CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE * 180 - 90, 6) AS lat,
        1 + CAST('0x' || substr(h, 17, 8) AS BIGINT) % 10 AS priority, 5 + CAST('0x' || substr(h, 25, 8) AS BIGINT) % 11 AS duration_s FROM (SELECT c_custkey AS k, md5('target|' || c_custkey) AS h FROM customer)""",
    ),
    "scenario_grid": (
        scenario_grid,
        """SELECT printf('scenario_%04d_M%d', row_number() OVER (ORDER BY c, m, d), m) AS name, c AS constellation, m AS missions, d AS days
        FROM (SELECT CAST(n_nationkey AS BIGINT) AS c FROM nation), (SELECT unnest([100::BIGINT, 500]) AS m), (SELECT unnest([0.5::DOUBLE, 1.0]) AS d)""",
    ),
}
