"""First and last attitude of each shape of container."""

import json

import pytest
from pyspark.sql import functions as F

from orbweave.functions.attitudes import attitude_of
from orbweave.sources import files

R = lambda *v: dict(zip(("roll", "pitch", "yaw"), v))
G = lambda *v: dict(zip(("gamma", "pi", "psi"), v))
A = lambda *v: dict(zip(("roll_angle", "pitch_angle", "yaw_angle"), v))
CASES = [
    ([R(1, 2, 3), R(4, 5, 6)], (1, 2, 3), (4, 5, 6)),
    ([G(1, 2, 3)], (1, 2, 3), (1, 2, 3)),
    ([A(1.5, "2", -3)], (1.5, 2, -3), (1.5, 2, -3)),
    ([R(1, 2, None), R(4, 5, 6)], None, (4, 5, 6)),
    ([R(1, 2, 3), {"roll": 4, "pitch": 5}], (1, 2, 3), None),
    ([{**R(1, 2, "x"), **G(7, 8, 9)}], None, None),  # the first set of names decides
    ([[1, 2, 3, 9], [4, 5, 6]], (1, 2, 3), (4, 5, 6)),
    ([[1, 2], [4, 5, 6]], None, (4, 5, 6)),
    (R([1, 7], [2], [3, 8, 9]), (1, 2, 3), (7, 2, 9)),
    (G([1, 7], [2, 8], [3, 9]), (1, 2, 3), (7, 8, 9)),
    (R([1], [], [3]), None, None),
    (R(1, 2, 3), None, None),  # lists are expected under these names
    ({**R(1, 2, 3), "inner": G(1, 2, 3)}, None, None),
    (A(1, 2, 3), (1, 2, 3), (1, 2, 3)),
    ({"n": 5, "attitude": R(1, 2, 3)}, (1, 2, 3), (1, 2, 3)),
    ({"a": {"roll": 1}, "b": G(1, 2, 3), "c": R(4, 5, 6)}, (1, 2, 3), (1, 2, 3)),
    ({}, None, None), ([], None, None), (5, None, None), ("text", None, None), ([7], None, None), (None, None, None),
]


def test_every_shape(spark):
    rows = [(i, json.dumps(c)) for i, (c, _, _) in enumerate(CASES)] + [(len(CASES), "not json"), (len(CASES) + 1, None)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("v", F.try_parse_json("j"))
    got = {r.i: (r.a and tuple(r.a), r.z and tuple(r.z)) for r in df.select("i", attitude_of(F.col("v")).alias("a"), attitude_of(F.col("v"), last=True).alias("z")).collect()}
    want = {i: (a, z) for i, (_, a, z) in enumerate(CASES)}
    assert got == {**want, len(CASES): (None, None), len(CASES) + 1: (None, None)}


def test_schedules_give_the_attitudes_of_their_assignments(spark, tmp_path):
    rows = [{"task_id": f"t{i}", "satellite_id": "s", "sat_start_time": "2025-01-01T00:00:00", **({} if i == 2 else {"sat_angles": c})} for i, c in enumerate([[R(1, 2, 3), R(4, 5, 6)], G([1, 7], [2, 8], [3, 9]), None])]
    (tmp_path / "x.json").write_text(json.dumps({"scenario_id": "S", "assignments": rows}))
    t = files.read_schedules(spark, str(tmp_path / "x.json"))
    got = {r.task_id: (tuple(r["first"]), tuple(r["last"])) for r in t["attitude"].collect()}
    assert got == {"t0": ((1, 2, 3), (4, 5, 6)), "t1": ((1, 2, 3), (7, 8, 9))} and t["assignment"].count() == 3 and "sat_angles" not in t["assignment"].columns
