"""Column functions of the scheduling domain: time, attitude, transitions, names, hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MU = 398600.4418

# Slew rates (degrees a second) of the four agility profiles, by size of the attitude change.
PROFILES = {
    "High-Agility": (3.0, 4.0, 5.0, 6.0),
    "Standard-Agility": (1.5, 2.0, 2.5, 3.0),
    "Low-Agility": (0.75, 1.0, 1.25, 1.5),
    "Limited-Agility": (0.5, 0.67, 0.83, 1.0),
}
DEFAULT_PROFILE = "Standard-Agility"
MIN_TRANSITION_S = 11.66
#: What a satellite that cannot turn by itself is given, unless the caller says otherwise.
NON_AGILE_S = 10.0


def either(value: Column, default) -> Column:
    """The value, or the default where it is null or zero."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def utc_time(text: Column) -> Column:
    """ISO time with Z or an offset, or none (taken as UTC); null where it cannot be read. Session time zone: UTC."""
    return F.try_to_timestamp(text)


def any_epoch(text: Column) -> Column:
    """Unix seconds, ISO or one of four written forms; null where none fits."""
    seconds = F.timestamp_seconds(text.try_cast("double"))
    forms = ("dd MMM yyyy HH:mm:ss.SSS", "dd MMM yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(seconds, *[F.try_to_timestamp(text, F.lit(f)) for f in forms], F.try_to_timestamp(text))


def maneuverability(*places: Column) -> Column:
    """non_agile or agile from the first place that says either; agile by default."""
    low = [F.lower(p) for p in places]
    said = [F.when(p.contains("non"), "non_agile").when(p.contains("agile"), "agile") for p in low]
    return F.coalesce(*said, F.lit("agile"))


def orbital_period_s(semi_major_axis_km: Column) -> Column:
    import math

    return 2 * math.pi * F.sqrt(F.pow(semi_major_axis_km, 3) / EARTH_MU)


def orbit_number(elapsed_s: Column, period_s: Column) -> Column:
    return (F.floor(F.greatest(elapsed_s, F.lit(0)) / period_s) + 1).cast("long")


def attitude_change(before: list[Column], after: list[Column]) -> Column:
    """Sum of absolute changes of roll, pitch and yaw in degrees."""
    total = F.abs(after[0] - before[0])
    for a, b in zip(after[1:], before[1:]):
        total = total + F.abs(a - b)
    return total


def profile_name(name: Column) -> Column:
    """One of the four profile names, whatever case and separators; the standard one for others."""
    plain = F.lower(F.regexp_replace(F.trim(name), "[ _]+", "-"))
    out = F
    for known in PROFILES:
        short = known.lower()
        hit = plain.isin(short, short.removesuffix("-agility"), short.replace("-", ""))
        out = out.when(hit, known)
    return out.otherwise(DEFAULT_PROFILE)


def transition_s(change: Column, profile: str = DEFAULT_PROFILE, agile: Column | None = None, non_agile_s: float = NON_AGILE_S) -> Column:
    """Seconds to turn by a change of attitude; constant for non-agile satellites, the minimum where it is unknown."""
    v = PROFILES[profile]
    turn = (
        F.when(change.isNull() | (change <= 10), MIN_TRANSITION_S)
        .when(change <= 30, 5 + change / v[0])
        .when(change <= 60, 10 + change / v[1])
        .when(change <= 90, 16 + change / v[2])
        .otherwise(22 + change / v[3])
    )
    return turn if agile is None else F.when(agile, turn).otherwise(non_agile_s)


def transition_bound_s(profile: str = DEFAULT_PROFILE) -> float:
    """No transition takes longer: a change of 360 degrees."""
    return 22 + 360 / PROFILES[profile][3]


def turn_s(agile: bool, change: int) -> float:
    """transition_s() of the default profile for one change."""
    if not agile:
        return NON_AGILE_S
    if change <= 10:
        return MIN_TRANSITION_S
    v = PROFILES[DEFAULT_PROFILE]
    return 5 + change / v[0] if change <= 30 else 10 + change / v[1] if change <= 60 else 16 + change / v[2] if change <= 90 else 22 + change / v[3]


def data_volume_gb(rate_mbps: Column, duration_s: Column) -> Column:
    return F.coalesce(rate_mbps * duration_s / (8 * 1024), F.lit(0.0))


def stable_seed(text: Column) -> Column:
    """31 bits from the first eight hex digits of the MD5."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).bitwiseAND(F.lit(0x7FFFFFFF))


def canonical_digest(**columns: Column) -> Column:
    """sha256: and the digest of the columns as JSON, names in alphabetical order, nulls kept."""
    fields = [columns[n].alias(n) for n in sorted(columns)]
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def round_trip_hex(column: Column) -> Column:
    """A double as text that restores every bit; null stays null. Spark has no built-in for it."""

    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else float(v).hex())

    return F.pandas_udf(text, "string")(column)


def size_class(satellites: Column, missions: Column, stations: Column) -> Column:
    """basic: few of each; multi_sat_multi_gs: many of one at least; other: between."""
    few = (satellites <= 3) & (missions <= 20) & (stations <= 3)
    many = (satellites > 10) | (missions > 200) | (stations > 5)
    return F.when(few, "basic").when(many, "multi_sat_multi_gs").otherwise("other")


# Semi-major axes in km that fit an orbit class, and whether the lower end belongs to it.
AXIS_RANGES = {"LEO": (6378, 9000, True), "MEO": (9000, 30000, False), "GEO": (40000, 45000, True)}


def axis_out_of_range(orbit_class: Column, axis_km: Column) -> Column:
    """Whether the axis does not fit its class; other classes have no range."""
    out = F.lit(False)
    for name, (low, high, closed) in AXIS_RANGES.items():
        inside = ((axis_km >= low) if closed else (axis_km > low)) & (axis_km <= high)
        out = F.when(orbit_class == name, ~inside).otherwise(out)
    return out


def path_template(path: Column) -> Column:
    """The lower-case path in which the numbers after _p, _cities_, _seed, _sf (any case) and _S (capital) are dropped
    where another part, the extension or nothing follows: paths of one experiment agree. Null gives an empty text."""
    out = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\", "/"), "/+", "/")
    for tag, flag in (("p", "(?i)"), ("cities_", "(?i)"), ("seed", "(?i)"), ("sf", "(?i)"), ("S", "")):
        out = F.regexp_replace(out, rf"{flag}_{tag}\d+_", f"_{tag.rstrip('_')}_")
        out = F.regexp_replace(out, rf"{flag}_{tag}\d+(?=\.|$)", f"_{tag}")
    return F.lower(out)


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def scale_of(name: Column) -> Column:
    """struct(satellites, missions, days, alias) from a name such as cities_01_Sats20_M500_T0.5d; nulls where a part is missing."""
    part = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return F.struct(
        part(r"Sats(\d+)").cast("int").alias("satellites"), part(r"_M(\d+)").cast("int").alias("missions"),
        part(r"_T([0-9.]+)d").try_cast("double").alias("days"), part(r"(cities_\d+)").alias("alias"),
    )


_WEIGHTS = r"p[\d.]+_c[\d.]+_t[\d.]+_b[\d.]+"
#: Objectives that a heuristic stands for by its name, in the order of the weights.
IMPLICIT = ("profit_first", "completion_first", "timeliness_first", "balance_first")


def schedule_name(stem: Column) -> Column:
    """struct(solver, class_id, objective, weights, model) from a schedule file's stem.

    Classes 1 and 2 end in _c1_solver_weights or _c2_solver_implicit, 3 in _c3_solver_weights, 4 in _c4_ppo_model with
    weights after it, inside the model's name, or none. Others are unknown, class -1. Weights without digits in a
    part, and unknown heuristics, give zeros.
    """
    part = lambda text, p, i=1: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    low, three = rf"_c([12])_([a-zA-Z_]+?)_({_WEIGHTS}|implicit)$", rf"_c3_(sa|ga|aco)_({_WEIGHTS})$"
    four = rf"_c4_ppo_([A-Za-z0-9._-]+?)(?:_({_WEIGHTS}))?$"
    model = F.when(~stem.rlike(low) & ~stem.rlike(three), part(stem, four))
    solver = F.coalesce(part(stem, low, 2), part(stem, three), F.when(model.isNotNull(), "ppo"), F.lit("unknown"))
    class_id = F.coalesce(part(stem, low).cast("int"), F.when(stem.rlike(three), 3), F.when(model.isNotNull(), 4), F.lit(-1))
    inside = F.when(model.isNotNull(), F.coalesce(part(stem, four, 2), part(model, f"({_WEIGHTS})"), F.lit("implicit")))
    objective = F.coalesce(part(stem, low, 3), part(stem, three, 2), inside, F.lit("unknown"))
    implied = F.array(*[(F.lower(solver) == n).cast("double") for n in IMPLICIT])
    told = F.array(*[F.coalesce(part(objective, rf"(?:^|_){c}([\d.]+)").try_cast("double"), F.lit(0.0)) for c in "pctb"])
    weights = F.when(objective == "implicit", implied).otherwise(told)
    return F.struct(solver.alias("solver"), class_id.alias("class_id"), objective.alias("objective"), weights.alias("weights"), model.alias("model"))


def objective_label(class_id: Column, solver: Column, weights: list[Column]) -> Column:
    """profit=..,completion=..,timeliness=..,balance=.. for the weighted classes, implicit(solver) for heuristics, N/A for others."""
    number = lambda w: F.regexp_replace(w.cast("string"), r"\.0$", "")
    text = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), number(w)) for n, w in zip(("profit", "completion", "timeliness", "balance"), weights)])
    return F.when(class_id.isin(1, 3, 4), text).when(class_id == 2, F.concat(F.lit("implicit("), solver, F.lit(")"))).otherwise("N/A")


def default_sensor(sensors: Column) -> Column:
    """The first sensor of mode VISIBLE in an array of structs with mode, else the first, else null."""
    return F.coalesce(F.get(F.filter(sensors, lambda s: s["mode"] == "VISIBLE"), 0), F.get(sensors, 0))


def finish_s(sat_end: Column, gs_end: Column) -> Column:
    return F.coalesce(gs_end, sat_end)


def busy_s(sat_start: Column, sat_end: Column, gs_start: Column, gs_end: Column) -> Column:
    """Seconds of observation and, where there is one, of the downlink."""
    return sat_end - sat_start + F.coalesce(gs_end - gs_start, F.lit(0))


def desirability(priority: Column, total_priority: Column, delay_s: Column, horizon_s: Column, weights: tuple[float, float, float]) -> Column:
    """Static worth of a candidate: weighted priority share, completion and earliness, above zero."""
    early = 1 - F.least(F.lit(1.0), F.greatest(delay_s, F.lit(0)) / F.when(horizon_s > 0, horizon_s).otherwise(1))
    share = priority / F.when(total_priority > 0, total_priority).otherwise(1)
    return F.greatest(F.lit(1e-6), weights[0] * share + weights[1] + weights[2] * early)


# What each of the ten features of a candidate is divided by.
FEATURE_SCALES = (1.0, 43200.0, 43200.0, 100.0, 0.01, 500.0, 10.0, 10.0, 43200.0, 100.0)


def candidate_features(start_s: Column, end_s: Column, volume_gb: Column, power_w: Column, orbit: Column, priority: Column, gs_start: Column, gs_end: Column) -> Column:
    """Ten doubles: skip flag, start, end, duration, volume, power, orbit, priority, start and length of the downlink.
    A null start is the skip: flag 1 and the priority, else zeros."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    skip = start_s.isNull()
    link = gs_start.isNotNull() & gs_end.isNotNull()
    own = [start_s, end_s, end_s - start_s, volume_gb, power_w, orbit]
    return F.array(
        skip.cast("double"), *[F.when(skip, 0.0).otherwise(zero(c)) for c in own], zero(priority),
        F.when(link & ~skip, zero(gs_start)).otherwise(0.0), F.when(link & ~skip, zero(gs_end - gs_start)).otherwise(0.0),
    )


def scaled_features(features: Column) -> Column:
    return F.zip_with(features, F.array(*[F.lit(x) for x in FEATURE_SCALES]), lambda a, b: a / b)


def action_key(task: Column, satellite: Column, sensor: Column, orbit: Column, window: Column, start_us: Column, end_us: Column) -> Column:
    """Canonical text of a choice: assign and its identity, times in microseconds from the scenario's start; skip where the window is null."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(window.isNull(), F.concat_ws("|", F.lit("skip"), text(task))).otherwise(
        F.concat_ws("|", F.lit("assign"), *map(text, (task, satellite, sensor, orbit, window, start_us, end_us)))
    )
