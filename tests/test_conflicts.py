"""Conflicts counted without their pairs, against loops over all pairs."""

import random

from orbweave.operators import conflicts
from orbweave.plans import registry


def test_overlaps_of_contacts_equal_all_pairs(spark):
    """Contacts of any length, none, negative or unknown ones among them, with many equal starts and ends."""
    rng = random.Random(7)
    rows = [(i % 2, i, s := rng.randrange(40), rng.choice([None, s, s - 3, *range(s + 1, s + 9)])) for i in range(160)]
    df = spark.createDataFrame(rows, "station_id long, comm_id long, start_s long, end_s long")
    want = {0: [0, 0], 1: [0, 0]}
    for k, i, s, e in rows:
        for m, j, b, f in rows:
            if k == m and (b, j) > (s, i) and e is not None and b < e:
                want[k][0] += 1
                want[k][1] += (e if f is None else min(e, f)) - b
    got = {r.station_id: [r.pairs, r.overlap_s] for r in conflicts.overlap_totals(df, ["station_id"]).collect()}
    assert got == want


def test_station_contention_takes_all_contacts_of_a_station(spark):
    """Stations are not cut by scenario, and all of them are the five of the events."""
    got = registry.queries()["station_contention"](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == ["overlap_s", "pairs", "station_id"] and {r.station_id for r in got.collect()} <= set(range(5))


def test_tasks_with_two_common_satellites_are_listed_once(spark):
    """Pairs of tasks that share only one satellite, or none, are not listed; all common satellites are summed."""
    rows = [("S", s, t, n) for s, t, n in [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 4), (3, 1, 1), (3, 2, 1), (1, 3, 5), (2, 4, 1), (3, 4, 2)]]
    df = spark.createDataFrame(rows, "scenario_id string, satellite_id long, task_id long, n long")
    got = [(r.task_i, r.task_j, r.satellites, r.comparable) for r in conflicts.shared_satellites(df).collect()]
    assert sorted(got) == [(1, 2, 3, 11), (1, 4, 2, 3), (2, 4, 2, 6)]


def test_candidates_in_conflict_equal_those_of_pairs(spark):
    from pyspark.sql import functions as F

    from orbweave.operators.candidates import candidates_of
    from orbweave.tables import Scenarios

    t = Scenarios(spark, "/root/testdata/sf0.001")
    listed = conflicts.candidate_conflicts(candidates_of(t)).groupBy("scenario_id", F.least("task_id", "r_task_id").alias("i"), F.greatest("task_id", "r_task_id").alias("j")).count()
    got = conflicts.conflicts_of_tasks(conflicts.places_of(t)).select("scenario_id", "task_i", "task_j", "conflicts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect()))
