"""Scenario, schedule, trajectory and log files as tables, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.functions.attitudes import attitude_of
from orbweave.functions.exprs import either, maneuverability, utc_time

_ANGLES = "pitch_angles:array<double>,yaw_angles:array<double>,roll_angles:array<double>,pitch:array<double>,yaw:array<double>,roll:array<double>"
_FIXED = "pitch_angle:double,yaw_angle:double,roll_angle:double,pitch:double,yaw:double,roll:double"
_PAYLOAD = "struct<maneuverability_type:string,attributes:struct<maneuverability_type:string>>"
SCENARIO = (
    "scenario_id string, scenario_type string, metadata struct<creation_time:string,duration:double,time_step:double,name:string>, "
    "satellites array<struct<id:string,maneuverability_type:string,satellite_specs:struct<max_data_storage_GB:double,max_power_W:double>,"
    f"maneuverability_capability:struct<maneuverability_type:string,type:string>,attributes:struct<maneuverability_type:string>,payload:{_PAYLOAD},payloads:array<{_PAYLOAD}>,"
    "observation_capability:struct<sensors:array<struct<sensor_id:string,data_rate_Mbps:double,power_consumption_W:double>>>>>, "
    "ground_stations array<struct<id:string>>, "
    "missions array<struct<id:string,priority:double,observation_requirement:struct<duration_s:double>>>, "
    "observation_windows array<struct<satellite_id:string,mission_id:string,sensor_id:string,time_windows:array<struct<start_time:string,"
    f"end_time:string,orbit_number:int,time_step:double,agile_data:struct<{_ANGLES}>,non_agile_data:struct<{_FIXED}>>>>>, "
    "communication_windows array<struct<satellite_id:string,ground_station_id:string,time_windows:array<struct<start_time:string,end_time:string>>>>"
)
SCHEDULE = (
    "scenario_id string, start_time string, end_time string, unassigned_tasks array<string>, assignments array<struct<task_id:string,"
    "satellite_id:string,sat_start_time:string,sat_end_time:string,sensor_id:string,orbit_number:int,data_volume_GB:double,power_cost_W:double,"
    "priority:double,ground_station_id:string,gs_start_time:string,gs_end_time:string,sat_angles:variant>>, metrics map<string,double>"
)
RUN_LOG_COLUMNS = 12
#: What each satellite of a constellation file carries.
PAYLOAD = {
    "maneuverability": "agile", "slew_rate": 1.0, "max_pitch_angle": 45.0, "max_yaw_angle": 45.0, "max_roll_angle": 45.0, "stabilization_time": 10.0,
    "resolution": "medium", "sensor_mode": "visible", "field_of_view": 45.0, "swath_width": 50.0, "min_elevation_angle": 0.0, "data_rate_mbps": 0.1, "power_w": 50.0,
    "antenna_type": "directional", "antenna_frequency": "x_band", "antenna_data_rate": 100.0, "antenna_power_w": 20.0, "antenna_concurrent": False,
    "max_storage_gb": 1000.0, "max_operation_time": 4500.0, "max_power_w": 500.0, "max_battery_capacity": 2000.0, "max_fuel": 100.0,
}


def _agility(s: Column) -> Column:
    """Manoeuvrability of a satellite (B03): capability, satellite, attributes, payload, payloads in their order."""
    own = lambda p: [p["maneuverability_type"], p["attributes"]["maneuverability_type"]]
    able = s["maneuverability_capability"]
    listed = F.flatten(F.transform(s["payloads"], lambda p: F.array(*own(p))))
    telling = F.get(F.filter(listed, lambda v: F.lower(v).contains("non") | F.lower(v).contains("agile")), 0)
    return maneuverability(F.coalesce(F.nullif(able["maneuverability_type"], F.lit("")), able["type"]), *own(s), *own(s["payload"]), telling)


def discover(spark: SparkSession, folder: str, rule: str = "analysis") -> DataFrame:
    """path of each scenario file under a folder (A12). Folders are taken below the given one, so its own name is free.

    analysis: names that start with scenario_ in any case, in no schedules folder; scheduling: the same with the exact
    prefix Scenario_; training: any name without "schedule", outside the schedules folder at the top.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").load(folder)
    store = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    top = re.sub(store, "", folder).rstrip("/")
    parts = F.split(F.substring(F.regexp_replace("path", store, ""), len(top) + 2, 1 << 20), "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    rules = {
        "analysis": F.lower(name).startswith("scenario_") & ~F.array_contains(folders, "schedules"),
        "scheduling": name.startswith("Scenario_") & name.endswith(".json") & ~F.array_contains(folders, "schedules"),
        "training": ~F.lower(name).contains("schedule") & ~F.coalesce(F.get(folders, 0) == "schedules", F.lit(False)),
    }
    return found.where(rules[rule]).select("path")


def read_scenarios(spark: SparkSession, path) -> dict[str, DataFrame]:
    """The tables of nested scenario files (A01): scenario, satellite, sensor, task, station, task_window, comm_window.

    Missing keys are null, null or zero limits take their defaults, times become UTC. Windows that end before they
    start, or name an unknown satellite, task or station, are left out; window_id numbers the kept ones of a file in
    their order.
    """
    raw = spark.read.schema(SCENARIO).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    satellite = raw.select("file", "scenario_id", F.explode("satellites").alias("s"))
    sat = satellite.select(
        "file", "scenario_id", F.col("s.id").alias("satellite_id"),
        _agility(F.col("s")).alias("maneuverability"),
        either(F.col("s.satellite_specs.max_data_storage_GB"), 0.0).alias("max_storage_gb"), either(F.col("s.satellite_specs.max_power_W"), 0.0).alias("max_power_w"),
    )
    sensor = satellite.select("file", "scenario_id", F.col("s.id").alias("satellite_id"), F.explode("s.observation_capability.sensors").alias("x")).select(
        "file", "scenario_id", "satellite_id", F.col("x.sensor_id").alias("sensor_id"),
        F.coalesce("x.data_rate_Mbps", F.lit(0.0)).alias("data_rate_mbps"), F.coalesce("x.power_consumption_W", F.lit(0.0)).alias("power_w"),
    )
    task = raw.select("file", "scenario_id", F.explode("missions").alias("m")).select(
        "file", "scenario_id", F.col("m.id").alias("task_id"), F.coalesce("m.priority", F.lit(0.0)).alias("priority"),
        F.coalesce("m.observation_requirement.duration_s", F.lit(0.0)).alias("duration_s"),
    )
    station = raw.select("file", "scenario_id", F.explode("ground_stations").alias("g")).select("file", "scenario_id", F.col("g.id").alias("station_id"))
    groups = raw.select("file", "scenario_id", F.posexplode("observation_windows").alias("i", "w"))
    windows = groups.select(
        "file", "scenario_id", "i", F.col("w.satellite_id").alias("satellite_id"), F.col("w.mission_id").alias("task_id"), F.col("w.sensor_id").alias("sensor_id"),
        F.posexplode("w.time_windows").alias("j", "t"),
    ).withColumns({"start": utc_time(F.col("t.start_time")), "end": utc_time(F.col("t.end_time"))})
    kept = windows.where("end > start").join(sat, ["file", "satellite_id"], "left_semi").join(task, ["file", "task_id"], "left_semi")
    order = Window.partitionBy("file").orderBy("i", "j")
    first = lambda names: F.coalesce(*[F.get(F.col(f"t.agile_data.{n}"), 0) for n in names[:2]], *[F.col(f"t.non_agile_data.{n}") for n in names[2:]])
    task_window = kept.select(
        "file", "scenario_id", F.row_number().over(order).alias("window_id"), "satellite_id", "task_id", "sensor_id", F.col("t.orbit_number").alias("orbit_number"),
        "start", "end", F.coalesce("t.time_step", F.lit(1.0)).alias("step_s"), "t.agile_data", "t.non_agile_data",
        *[first((f"{a}_angles", a, f"{a}_angle", a)).alias(f"{a}0") for a in ("roll", "pitch", "yaw")],
    )
    contacts = raw.select("file", "scenario_id", F.explode("communication_windows").alias("c")).select(
        "file", "scenario_id", F.col("c.satellite_id").alias("satellite_id"), F.col("c.ground_station_id").alias("station_id"), F.explode("c.time_windows").alias("t")
    )
    comm_window = (
        contacts.select("file", "scenario_id", "satellite_id", "station_id", utc_time(F.col("t.start_time")).alias("start"), utc_time(F.col("t.end_time")).alias("end"))
        .where("end > start")
        .join(sat, ["file", "satellite_id"], "left_semi")
        .join(station, ["file", "station_id"], "left_semi")
    )
    scenario = raw.select(
        "file", "scenario_id", "scenario_type", utc_time(F.col("metadata.creation_time")).alias("start"),
        F.col("metadata.duration").alias("duration_s"), F.col("metadata.time_step").alias("step_s"),
    )
    return {"scenario": scenario, "satellite": sat, "sensor": sensor, "task": task, "station": station, "task_window": task_window, "comm_window": comm_window}


def read_schedules(spark: SparkSession, path) -> dict[str, DataFrame]:
    """assignment, unassigned, metrics and attitude of schedule files, each with schedule_file (A02); attitude has the first
    and last one of each assignment that gives its angles, whatever their container (B14)."""
    raw = spark.read.schema(SCHEDULE).option("multiLine", True).json(path).withColumn("schedule_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    a = raw.select("schedule_file", "scenario_id", F.explode("assignments").alias("a")).select("schedule_file", "scenario_id", "a.*")
    for c in ("sat_start_time", "sat_end_time", "gs_start_time", "gs_end_time"):
        a = a.withColumn(c, utc_time(F.col(c)))
    angles = F.col("sat_angles")
    attitude = a.where("sat_angles IS NOT NULL").select(
        "schedule_file", "scenario_id", "task_id", "satellite_id", "sat_start_time", attitude_of(angles).alias("first"), attitude_of(angles, last=True).alias("last")
    )
    a = a.drop("sat_angles")
    unassigned = raw.select("schedule_file", "scenario_id", F.explode("unassigned_tasks").alias("task_id"))
    return {"assignment": a, "unassigned": unassigned, "metrics": raw.select("schedule_file", "scenario_id", F.explode("metrics").alias("metric", "value")), "attitude": attitude}


def read_constellation(spark: SparkSession, path: str) -> DataFrame:
    """satellite_id, orbit class, elements and epoch from a map of lists, and the constant payload; unreadable numbers
    are null, short lists leave their last columns null (A03)."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("satellite_id", "v"))
    names = ("semi_major_axis_km", "eccentricity", "inclination", "arg_perigee", "raan", "mean_anomaly")
    elements = [F.get("v", i + 1).try_cast("double").alias(n) for i, n in enumerate(names)]
    parts = [F.concat("satellite_id", F.lit("_sensor")).alias("sensor_id"), F.concat("satellite_id", F.lit("_x_antenna")).alias("antenna_id")]
    return rows.select("satellite_id", F.get("v", 0).alias("orbit_class"), *elements, F.get("v", 7).alias("epoch"), *parts, *[F.lit(x).alias(n) for n, x in PAYLOAD.items()])


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """name, lon, lat from a map of pairs (A04). A pair is lon, lat unless only the other order fits the ranges. A
    file without a pair is an error when rows are read."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    pairs = F.from_json("value", "map<string,array<double>>")
    pairs = F.when(F.coalesce(F.size(pairs), F.lit(0)) < 1, F.raise_error(F.concat(F.lit("no target in "), "file"))).otherwise(pairs)
    rows = text.select(F.explode(pairs).alias("name", "p"))
    a, b = F.get("p", 0), F.get("p", 1)
    swapped = (F.abs(a) <= 90) & (F.abs(b) > 90)
    return rows.select("name", F.round(F.when(swapped, b).otherwise(a), 6).alias("lon"), F.round(F.when(swapped, a).otherwise(b), 6).alias("lat"))


def read_trajectories(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines with `corrupt`, the text of lines that cannot be read, for the validator to report or drop."""
    return spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def write_trajectories(df: DataFrame, path: str) -> None:
    """JSON lines, a folder for each schedule file."""
    df.write.mode("overwrite").partitionBy("schedule_file").json(path)


def read_run_log(spark: SparkSession, path: str, scenario: str) -> DataFrame:
    """Rows of a piped run log that name <scenario>.json, columns by the header row, numbers where they read."""
    lines = spark.read.text(path).select(F.transform(F.split("value", r"\|"), lambda x: F.trim(x)).alias("c"), F.col("value").alias("line"))
    rows = lines.where((F.size("c") >= RUN_LOG_COLUMNS) & F.col("line").contains(f"{scenario}.json"))
    header = [x.strip() for x in (lines.where(F.array_contains("c", "Algorithm")).select("line").first() or [""])[0].split("|")]
    number = {"TP", "TCR", "BD", "TM", "RT", "RV"}
    return rows.select(*[(F.get("c", i).try_cast("double") if h in number else F.get("c", i)).alias(h or f"c{i}") for i, h in enumerate(header)])


def format_run_log(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """line: cells of fixed width, numbers with three decimals, long text cut with dots."""
    cells = []
    for name, width in widths.items():
        c = F.col(name)
        text = F.format_string("%.3f", c) if dict(df.dtypes)[name] == "double" else c.cast("string")
        text = F.coalesce(text, F.lit("-"))
        cells.append(F.rpad(F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text), width, " "))
    return df.select(F.concat_ws(" | ", *cells).alias("line"))


def scenario_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """file and json of the tables that read_scenarios gives, for it to read again (A13): satellites with their sensors,
    stations, missions, windows with their angles and contacts, grouped as in a file. A file without rows of a kind has
    an empty list of it."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(f"{c}_time")

    def listed(df: DataFrame, keys: list[str], name: str, *fields) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    ident = F.col("satellite_id").alias("id")
    sensors = listed(tables["sensor"], ["file", "satellite_id"], "sensors", "sensor_id", F.col("data_rate_mbps").alias("data_rate_Mbps"), F.col("power_w").alias("power_consumption_W"))
    specs = F.struct(F.col("max_storage_gb").alias("max_data_storage_GB"), F.col("max_power_w").alias("max_power_W")).alias("satellite_specs")
    satellites = tables["satellite"].join(sensors, ["file", "satellite_id"], "left")
    tw = tables["task_window"]
    windows = listed(tw, ["file", "satellite_id", F.col("task_id").alias("mission_id"), "sensor_id"], "time_windows", iso("start"), iso("end"), "orbit_number", F.col("step_s").alias("time_step"), "agile_data", "non_agile_data")
    contacts = listed(tables["comm_window"], ["file", "satellite_id", F.col("station_id").alias("ground_station_id")], "time_windows", iso("start"), iso("end"))
    mission = (F.col("task_id").alias("id"), "priority", F.struct("duration_s").alias("observation_requirement"))
    lists = {
        "satellites": listed(satellites, ["file"], "satellites", ident, F.col("maneuverability").alias("maneuverability_type"), specs, F.struct("sensors").alias("observation_capability")),
        "ground_stations": listed(tables["station"], ["file"], "ground_stations", F.col("station_id").alias("id")),
        "missions": listed(tables["task"], ["file"], "missions", *mission),
        "observation_windows": listed(windows, ["file"], "observation_windows", "satellite_id", "mission_id", "sensor_id", "time_windows"),
        "communication_windows": listed(contacts, ["file"], "communication_windows", "satellite_id", "ground_station_id", "time_windows"),
    }
    at = F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creation_time")
    rows = tables["scenario"].select("file", "scenario_id", "scenario_type", F.struct(at, F.col("duration_s").alias("duration"), F.col("step_s").alias("time_step")).alias("metadata"))
    for name, df in lists.items():
        rows = rows.join(df, "file", "left").withColumn(name, F.coalesce(name, F.array()))
    return rows.select("file", F.to_json(F.struct("scenario_id", "scenario_type", "metadata", *lists)).alias("json"))


def schedule_documents(assignment: DataFrame, unassigned: DataFrame, metrics: DataFrame) -> DataFrame:
    """schedule_file and json of each schedule (A14), also of those that only leave tasks out or have only metrics."""
    key = ["schedule_file", "scenario_id"]
    body = [c for c in assignment.columns if c not in key]
    a = assignment.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*body))).alias("assignments"))
    u = unassigned.groupBy("schedule_file").agg(F.array_sort(F.collect_list("task_id")).alias("unassigned_tasks"))
    m = metrics.groupBy("schedule_file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    named = a.select(*key).union(unassigned.select(*key)).union(metrics.select(*key)).distinct()
    rows = named.join(a.drop("scenario_id"), "schedule_file", "left").join(u, "schedule_file", "left").join(m, "schedule_file", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array()) for c in ("assignments", "unassigned_tasks")})
    return rows.select("schedule_file", F.to_json(F.struct("scenario_id", "assignments", "unassigned_tasks", "metrics")).alias("json"))


def write_manifests(trace: DataFrame, state: DataFrame, path: str) -> None:
    """Replay manifests (A15): JSON lines below path/trace and path/states, a folder for each schedule_file; the states
    of a schedule are in the order of step within each of its files. Earlier manifests of other schedules stay."""
    for name, df, order in (("trace", trace, []), ("states", state, ["step"])):  # ranges split a schedule of many states
        body = [c for c in sorted(df.columns) if c != "schedule_file"]  # keys in order of their names
        rows = df.select("schedule_file", *order, F.to_json(F.struct(*body)).alias("json")).repartitionByRange("schedule_file", *order).sortWithinPartitions("schedule_file", *order)
        rows.select("schedule_file", "json").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schedule_file").text(f"{path}/{name}")


def write_summaries(rows: DataFrame, group: str, path: str) -> None:
    """CombinedSummary, a row per file, and AveragedSummary, means of the numbers by group with the number of files, as
    CSV tables with a header (A11)."""
    numbers = [n for n, t in rows.dtypes if t in ("int", "bigint", "float", "double")]
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/CombinedSummary")
    means = rows.groupBy(group).agg(F.count("*").alias("files"), *[F.avg(n).alias(n) for n in numbers])
    means.write.mode("overwrite").option("header", True).csv(f"{path}/AveragedSummary")


def new_labels(store: DataFrame, labels: DataFrame) -> DataFrame:
    """labels whose key the store lacks; a key with another payload, in either, is an error when rows are read."""
    both = store.select("key", "payload").union(labels.select("key", "payload"))
    error = F.raise_error(F.concat(F.lit("payloads differ for key "), "key")).cast("string")
    clash = both.groupBy("key").agg(F.count_distinct("payload").alias("n")).where("n > 1").select(F.when(F.col("n") > 1, error).alias("key"))
    fresh = labels.dropDuplicates(["key"]).join(store.select("key"), "key", "left_anti")
    return fresh.join(clash, "key", "left_anti")


def shuffled(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(F.xxhash64(F.lit(seed), row_id), row_id)
