"""Running numbers and sums over few large groups, without one task that sorts a whole group.

Rows are dealt by their group and by coarse columns that ascend in the same order; each part is sorted alone and
starts from what the parts before it hold. Only the table of parts is ordered by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.session import new_path, written


def running(df: DataFrame, keys: list[str], coarse: dict[str, Column], order: list, values: dict[str, Column]) -> DataFrame:
    """df with a column for each of values: its sum over the rows before this one, by coarse and then order.

    coarse: columns that order agrees with; rows with a null key are lost. order should be a total one.
    """
    part = [*keys, *coarse]
    df = df.withColumns(coarse)
    sums = df.groupBy(*part).agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in values])
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, part).withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    return out.drop(*coarse, *[f"__{n}" for n in values])


def numbered(df: DataFrame, keys: list[str], coarse: dict[str, Column], order: list, out: str) -> DataFrame:
    """df with out: 0, 1, ... within keys, as row_number() would count by the same order."""
    return running(df, keys, coarse, order, {out: F.lit(1)}).withColumn(out, F.col(out).cast("long"))


def ranked(df: DataFrame, keys: list[str], order: dict[str, Column], rank: str, count: str | None = None, parts: int | None = None) -> DataFrame:
    """df with rank (1, 2, ... within keys by the order columns, which should be total)
    and count (rows of the keys), for keys and orders of any kind and groups of any size.

    Rows are dealt by ranges of keys and order, whose bounds Spark takes from a sample of them; the table of that is
    written, so that a row's part never changes. Parts are counted, and each is numbered from what lies before it.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = {f"__o{i}": c for i, c in enumerate(order.values())}
    dealt = df.withColumns(named).repartitionByRange(parts, *keys, *named).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, new_path(spark, "ranges"))
    sizes = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))  # a row for each range and key that it holds
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy(*keys))}).drop("__n")
    joined = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__part"]]
    on = joined[0]
    for c in joined[1:]:
        on = on & c
    out = dealt.alias("l").join(sizes.alias("r"), on).select("l.*", "r.__before", "r.__all")
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*named))
    out = out.withColumn(rank, (F.col("__before") + own).cast("long"))
    if count:
        out = out.withColumn(count, F.col("__all"))
    return out.drop(*named, "__part", "__before", "__all")
