"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows handed to Python at once.
BATCH_BYTES = 8_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests)
    gets a folder of its own and a cluster an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.orbweave.scratch", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-orbweave-", dir="/tmp")
        spark.conf.set("spark.orbweave.scratch", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/orbweave/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the plans made inside; those of before come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def cut(df: DataFrame, name: str, batch_rows: int | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors lose nothing.

    Shuffle files of the job go when the table stands. batch_rows: rows handed to Python at once, BATCH_BYTES at most.
    more: settings for this job alone.
    """
    path = scratch_path(df.sparkSession, name)
    values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (more or {})
    if batch_rows:
        values |= {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    with settings(df.sparkSession, values):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by cut() once nothing reads them any more."""
    for file in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if "/orbweave/" in file:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def partitions_for(spark: SparkSession, n: int) -> int:
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
