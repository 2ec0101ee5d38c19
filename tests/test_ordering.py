"""Ranks by ranges against sorting, with ties between keys, nulls, one group and empty tables."""

import random

from pyspark.sql import functions as F

from orbweave.plans.ordering import ranked


def test_ranks_equal_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", rng.choice([None, 0.5, 1.5, 2.5]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, x double, i long")
    for parts in (1, 7, 40):
        got = ranked(df, ["g"], {"x": F.col("x"), "i": F.col("i")}, "rank", "n", parts)
        assert got.columns == ["g", "x", "i", "rank", "n"]
        for g in ("a", "b", None, "hot"):
            want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            own = sorted((r for r in got.collect() if r.g == g), key=lambda r: r.rank)
            assert [(r.x, r.i) for r in own] == [(r[1], r[2]) for r in want] and {r.n for r in own} == {len(want)} and [r.rank for r in own] == list(range(1, len(want) + 1))
    assert ranked(df.limit(0), ["g"], {"i": F.col("i")}, "rank").count() == 0


def test_digests_ignore_order_and_show_changes(spark):
    from orbweave.operators.catalogs import digest_tree

    rows = [("a", f"x{i}") for i in range(300)] + [("b", None), ("b", ""), ("b", "x1")]
    digest = lambda r: {x.g: (x.rows, x.digest) for x in digest_tree(spark.createDataFrame(r, "g string, t string"), ["g"], F.col("t")).collect()}
    whole = digest(rows)
    assert digest(rows[::-1]) == whole and whole["a"][0] == 300 and whole["b"][0] == 3
    assert digest(rows + [("a", "x1")])["a"] != whole["a"] and digest(rows[1:])["a"] != whole["a"] and digest(rows[1:])["b"] == whole["b"]


def test_candidates_of_unknown_satellites_stay(spark):
    from orbweave.operators.candidates import enumerate_candidates

    w = spark.createDataFrame([("S", 1, 9, 5, 1, 0, 40, 10, 3)], "scenario_id string, window_id long, satellite_id long, task_id long, orbit_number long, start_s long, end_s long, step_s long, seed long")
    task = spark.createDataFrame([("S", 5, 2, 10)], "scenario_id string, task_id long, priority long, duration_s long")
    satellites = spark.createDataFrame([(1, "non_agile", 0.1, 50.0)], "satellite_id long, maneuverability string, data_rate_mbps double, power_w double")
    got = enumerate_candidates(w, task, satellites).collect()
    assert sorted(r.k for r in got) == [0, 1, 2, 3] and {(r.data_volume_gb, r.power_w, r.maneuverability) for r in got} == {(0.0, 0.0, "agile")}
