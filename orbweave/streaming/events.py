"""Structured Streaming jobs over the event table: occupancy, sessions, late rows, validation, last row wins.

Each query replays the table as a stream, runs until all of it is read, and returns what the sink holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orbweave.session import new_path

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parquet*")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there now and return the rows of its sink.

    append writes files. complete keeps the last full result; it is for session windows alone, which know no updates.
    """
    spark, base = stream.sparkSession, new_path(stream.sparkSession, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that batches have written below path, with batch, the number of each."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(f"{path}/batch=*")


def last_of_keys(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each of keys: the one that is last by order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*keys, *[f"m.{c}" for c in rest])


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregation in update mode and return the last row of each of keys. A batch writes the rows that it changed
    under its own number, so a batch that runs again replaces what it wrote, and closed windows are never written again."""
    spark, base = stream.sparkSession, new_path(stream.sparkSession, "stream")
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")).start().awaitTermination()
    return last_of_keys(_batches(spark, f"{base}/rows", stream.schema), keys, ["batch"]).drop("batch")


class Upsert:
    """Merge by key of a stream without state in memory (S02): a batch keeps its own last row of each key under its number;
    readers take the last of all batches. run() goes on from the checkpoint; a batch that runs again replaces its rows."""

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], base: str | None = None):
        self.spark, self.keys, self.order = spark, keys, order
        self.base = base or new_path(spark, "upsert")

    def keep(self, df: DataFrame, batch: int) -> None:
        last_of_keys(df, self.keys, self.order).write.mode("overwrite").parquet(f"{self.base}/rows/batch={batch}")

    def run(self, stream: DataFrame) -> None:
        writer = stream.writeStream.option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True)
        writer.foreachBatch(self.keep).start().awaitTermination()

    def rows(self, schema) -> DataFrame:
        return last_of_keys(_batches(self.spark, f"{self.base}/rows", schema).drop("batch"), self.keys, self.order)


class LateRows:
    """Counts by window of a stream, and of the rows that came too late for it.

    The watermark of a batch is the latest time of the batches before it less delay_s. A row is late if its window has
    ended by then. Counts, late counts and the latest time are written under the batch's number, so that a batch that runs
    again gives the same. Rows without a time are counted as late, in a window without a start.
    """

    def __init__(self, spark: SparkSession, delay_s: int, size_s: int, base: str | None = None):
        self.spark, self.delay_s, self.size_s = spark, delay_s, size_s
        self.base = base or new_path(spark, "late")

    def watermark(self, batch: int) -> int | None:
        if batch == 0:
            return None
        marks = self.spark.read.schema("at_s long, batch long").option("basePath", f"{self.base}/marks").parquet(*[f"{self.base}/marks/batch={b}" for b in range(batch)])
        latest = marks.agg(F.max("at_s")).first()[0]
        return None if latest is None else latest - self.delay_s

    def keep(self, df: DataFrame, batch: int) -> None:
        at = F.unix_timestamp("ts")
        df.agg(F.max(at).alias("at_s")).write.mode("overwrite").parquet(f"{self.base}/marks/batch={batch}")
        mark = self.watermark(batch)
        start = F.floor(at / self.size_s) * self.size_s
        late = F.lit(False) if mark is None else start + self.size_s <= mark
        rows = df.select(start.cast("long").alias("start_s"), F.coalesce(late, F.lit(True)).alias("late"))
        counts = rows.groupBy("start_s").agg(F.count_if(~F.col("late")).alias("n"), F.count_if("late").alias("late"))
        counts.write.mode("overwrite").parquet(f"{self.base}/rows/batch={batch}")

    def run(self, stream: DataFrame) -> None:
        writer = stream.writeStream.option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True)
        writer.foreachBatch(self.keep).start().awaitTermination()

    def counts(self) -> DataFrame:
        schema = StructType([StructField(c, LongType()) for c in ("start_s", "n", "late")])
        return _batches(self.spark, f"{self.base}/rows", schema).groupBy("start_s").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


def in_parts(spark: SparkSession, sf_dir: str, parts: int, run) -> None:
    """Call run with the event stream once for each part of the events: the part's files come to the source, and the stream
    goes on from where it ended. Parts go by event_id, so that times of later parts lie before those of earlier ones."""
    source = new_path(spark, "source")
    events = spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet")
    for part in range(parts):
        events.where(F.pmod("event_id", F.lit(parts)) == part).write.mode("append").parquet(source)
        run(spark.readStream.schema(SCHEMA).parquet(source))


def occupancy(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Rows of each resource in tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = [F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("high")]
    g = events.groupBy(window.alias("w"), (F.col("user_id") % 5).alias("resource_id")).agg(*counts)
    return g.select(F.unix_timestamp("w.start").alias("start_s"), "resource_id", "n", "high")


def stream_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a day, kept as a complete result."""
    return run_updates(occupancy(event_stream(spark, sf_dir).withWatermark("ts", "40 days"), "1 day"), ["start_s", "resource_id"])


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day that start every six hours."""
    return run_updates(occupancy(event_stream(spark, sf_dir).withWatermark("ts", "40 days"), "1 day", "6 hours"), ["start_s", "resource_id"])


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of visible samples of each resource, ended by an hour without one."""
    seen = event_stream(spark, sf_dir).withWatermark("ts", "40 days").where("value > 20")
    g = seen.groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return run_to_table(g.select("user_id", F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp("w.end").alias("end_s"), "n"), "complete")


def stream_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of stateless checks by day: missing fields, values out of range, unreadable properties."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "40 days")
    checks = {
        "rows": F.count("*"),
        "no_type": F.count_if(F.col("event_type").isNull()),
        "out_of_range": F.count_if(~F.col("value").between(0, 100)),
        "no_key": F.count_if(F.get_json_object("props", "$.k").isNull()),
    }
    g = e.groupBy(F.window("ts", "1 day").alias("w")).agg(*[c.alias(n) for n, c in checks.items()])
    return run_updates(g.select(F.unix_timestamp("w.start").alias("start_s"), *checks), ["start_s"])


def stream_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, merged by key in four restarts of the stream."""
    last = Upsert(spark, ["user_id", "event_type"], ["ts", "event_id"])
    in_parts(spark, sf_dir, 4, last.run)
    return last.rows(spark.createDataFrame([], SCHEMA).schema).select("user_id", "event_type", "event_id", "value")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day that came in time and too late by ten days, in four restarts of the stream."""
    late = LateRows(spark, 10 * 86_400, 86_400)
    in_parts(spark, sf_dir, 4, late.run)
    return late.counts()


_DAY = "CAST(epoch(date_trunc('day', ts)) AS BIGINT)"

QUERIES = {
    "stream_occupancy": (stream_occupancy, f"SELECT {_DAY} AS start_s, user_id % 5 AS resource_id, count(*) AS n, count(*) FILTER (value > 20) AS high FROM events GROUP BY ALL"),
    "stream_sliding": (
        stream_sliding,
        """SELECT start_s, user_id % 5 AS resource_id, count(*) AS n, count(*) FILTER (value > 20) AS high FROM (
        SELECT *, (CAST(epoch(date_trunc('second', ts)) AS BIGINT) // 21600 - unnest([0, 1, 2, 3])) * 21600 AS start_s FROM events) GROUP BY ALL""",
    ),
    "stream_sessions": (
        stream_sessions,
        """SELECT user_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS start_s, CAST(epoch(date_trunc('second', max(ts) + INTERVAL 1 HOUR)) AS BIGINT) AS end_s, count(*) AS n FROM (
        SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS r FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR >= ts THEN 0 ELSE 1 END AS nw
          FROM events WHERE value > 20)) GROUP BY user_id, r""",
    ),
    "stream_validation": (
        stream_validation,
        f"""SELECT {_DAY} AS start_s, count(*) AS "rows", count(*) FILTER (event_type IS NULL) AS no_type, count(*) FILTER (NOT value BETWEEN 0 AND 100) AS out_of_range,
        count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS no_key FROM events GROUP BY ALL""",
    ),
    "stream_late_rows": (
        stream_late_rows,
        """WITH e AS (SELECT event_id % 4 AS part, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_s FROM events),
        m AS (SELECT part, max(max(at_s)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 864000 AS mark FROM e GROUP BY part)
        SELECT at_s // 86400 * 86400 AS start_s, count(*) FILTER (mark IS NULL OR (at_s // 86400 + 1) * 86400 > mark) AS n, count(*) FILTER ((at_s // 86400 + 1) * 86400 <= mark) AS late
        FROM e JOIN m USING (part) GROUP BY ALL""",
    ),
    "stream_last_row": (stream_last_row, "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL"),
}
