"""Streams that restart, repeat a batch and get late rows; and the reader of run logs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orbweave.sources import files
from orbweave.streaming import events

DAY = datetime(2025, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame([(i, DAY + timedelta(hours=h) if h is not None else None, 1, "view", float(i), "{}") for i, h in rows], events.SCHEMA)


def _stream(spark, source):
    return spark.readStream.schema(events.SCHEMA).parquet(source)


def test_late_rows_are_counted_once_over_restarts(spark, tmp_path):
    source, late = str(tmp_path / "in"), events.LateRows(spark, 6 * 3600, 3600, str(tmp_path / "late"))
    # 12 h is the mark of the first batch, so the second takes windows that end after 6 h; then 30 h, 24 h
    for part in ([(1, 1), (2, 12)], [(3, 5), (4, 6), (5, 30), (6, None)], [(7, 23), (8, 24), (9, 40)]):
        _events(spark, part).coalesce(1).write.mode("append").parquet(source)
        late.run(_stream(spark, source))
    got = {r.start_s: (r.n, r.late) for r in late.counts().collect()}
    hour = lambda h: int((DAY - datetime(1970, 1, 1)).total_seconds()) + 3600 * h
    assert got == {hour(1): (1, 0), hour(12): (1, 0), hour(5): (0, 1), hour(6): (1, 0), hour(30): (1, 0), None: (0, 1), hour(23): (0, 1), hour(24): (1, 0), hour(40): (1, 0)}
    late.keep(_events(spark, [(3, 5), (4, 6), (5, 30), (6, None)]), 1)  # the batch again
    assert {r.start_s: (r.n, r.late) for r in late.counts().collect()} == got


def test_merge_goes_on_from_the_checkpoint(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "merged")
    for part in ([(1, 5), (2, 3)], [(3, 4)], [(4, 9), (5, 9)]):
        _events(spark, part).coalesce(1).write.mode("append").parquet(source)
        events.Upsert(spark, ["user_id", "event_type"], ["ts", "event_id"], base).run(_stream(spark, source))
    merged = events.Upsert(spark, ["user_id", "event_type"], ["ts", "event_id"], base)
    schema = _events(spark, []).schema
    assert [r.event_id for r in merged.rows(schema).collect()] == [5]
    merged.keep(_events(spark, [(1, 5), (2, 3)]), 0)
    assert [r.event_id for r in merged.rows(schema).collect()] == [5]
    assert spark.read.parquet(f"{base}/rows").count() == 3  # a row of the key for each batch


def test_updates_keep_the_last_value_of_a_window(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in ([(1, 1), (2, 2)], [(3, 3)]):
        _events(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "10 days")
    got = events.run_updates(events.occupancy(stream, "1 day"), ["start_s", "resource_id"]).collect()
    assert [(r.n, r.high) for r in got] == [(3, 0)]


def test_run_log_rows_of_a_scenario(spark, tmp_path):
    names = ["Time", "Algorithm", "Class", "Objective", "TP", "TCR", "BD", "TM", "RT", "RV", "Seed", "Note"]
    lines = [
        "Parallel: mip=10", " | ".join(names), "-" * 40,
        "t0 | SA | 2 | p | 10.5 | 0.8 | 0.9 | 0.1 | 86.1 | - | 1 | scenario_json=a/S1.json",
        "t1 | GA | 2 | p | 11 | x | 0.9 | 0.1 | 666 | 2 | 1 | scenario_json=a/S1.json",
        "t2 | GA | 2 | p | 12 | 0.7 | 0.9 | 0.1 | 660 | 2 | 1 | scenario_json=a/S2.json", "short | row | S1.json",
    ]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    got = {r.Algorithm: r for r in files.read_run_log(spark, str(tmp_path / "log.txt"), "S1").collect()}
    assert set(got) == {"SA", "GA"} and (got["SA"].TP, got["SA"].RV, got["GA"].TCR, got["GA"].RT) == (10.5, None, None, 666.0)
    assert files.read_run_log(spark, str(tmp_path / "log.txt"), "S3").count() == 0


def test_watermark_of_the_first_batch_is_open(spark, tmp_path):
    late = events.LateRows(spark, 60, 60, str(tmp_path / "late"))
    assert late.watermark(0) is None
    late.keep(_events(spark, []), 0)
    late.keep(_events(spark, [(1, 1)]), 1)  # nothing came before, so nothing is late
    assert [(r.n, r.late) for r in late.counts().where(F.col("start_s").isNotNull()).collect()] == [(1, 0)]
