"""Suffix order of many symbol sequences by a distributed difference-cover algorithm (modulo 3).

Positions 1 and 2 modulo 3 are the sample. Their triples are sorted and named by place; while names repeat and cover
too little, the order of the sample comes from a recursion on the names, the two residues of a sequence being two
shorter sequences. The remaining suffixes are sorted by their first symbol and the rank of the sampled suffix behind
it, and merged into the sample by counting, in two sorts, how many of them stand before each sampled suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.llm.common import cut, drop_scratch

_PART = 33
#: For joins of tables that are both dealt by a part of the join's key.
BY_PART_OF_KEY = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def in_order(df: DataFrame, columns: list[str], name: str, more: dict[str, str] | None = None) -> DataFrame:
    """df written in the order of columns, with `mid`: ascending in that order, partition number in its upper bits."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    return cut(placed.withColumn("mid", F.monotonically_increasing_id()), name, more=more)


def running_count(ordered: DataFrame, flag: str, out: str) -> DataFrame:
    """ordered with out: flagged rows before each row. Sums per partition are few and go through a small join."""
    part = F.shiftright("mid", _PART)
    per = ordered.where(flag).groupBy(part.alias("__part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    before, total = [], 0
    counts = {r["__part"]: r["n"] for r in per}
    for p in range(max(counts, default=-1) + 2):
        before.append((p, total))
        total += counts.get(p, 0)
    offsets = F.broadcast(ordered.sparkSession.createDataFrame(before, "__part long, __before long"))
    last = before[-1][1]
    inside = Window.partitionBy("__part").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.count(F.when(F.expr(flag), 1)).over(inside), F.lit(0))
    return (
        ordered.withColumn("__part", part)
        .join(offsets, "__part", "left")
        .withColumn(out, own + F.coalesce("__before", F.lit(last)))
        .drop("__part", "__before")
    )


def with_neighbours(ordered: DataFrame, columns: list[str]) -> DataFrame:
    """ordered with prev and next: structs of columns of the rows before and after, over partition borders too."""
    part = F.shiftright("mid", _PART)
    value = F.struct(*columns)
    ends = ordered.groupBy(part.alias("__part")).agg(F.max_by(value, "mid").alias("last"), F.min_by(value, "mid").alias("first"))
    by = Window.orderBy("__part")  # one row a partition
    ends = F.broadcast(ends.select("__part", F.lag("last").over(by).alias("__left"), F.lead("first").over(by).alias("__right")))
    inside = Window.partitionBy("__part").orderBy("mid")
    return (
        ordered.withColumn("__part", part)
        .join(ends, "__part")
        .withColumn("prev", F.coalesce(F.lag(value).over(inside), F.col("__left")))
        .withColumn("next", F.coalesce(F.lead(value).over(inside), F.col("__right")))
        .drop("__part", "__left", "__right")
    )


def suffix_order(seq: DataFrame, need: int, names_needed: int, known: int = 3) -> DataFrame:
    """(run, pos, mid): mid ascends with the suffix of sequence `run` that starts at `pos`.

    seq: run (any groupable type), pos (0, 1, ... without gaps in a run), name (long, above 0), size (what it covers).
    Suffixes that agree wholly, or on what covers `need`, or on `names_needed` names at least may stand in either
    order. Shorter suffixes come first. An empty input gives an empty order. known: names of the first call that a
    triple of this one stands for.
    """
    spark = seq.sparkSession
    by = Window.partitionBy("run").orderBy("pos")
    ahead = {"n1": F.lead("name", 1, 0).over(by), "n2": F.lead("name", 2, 0).over(by)}
    size = F.col("size") + F.lead("size", 1, 0).over(by) + F.lead("size", 2, 0).over(by)
    triples = cut(seq.select("run", "pos", "name", "size").withColumns(ahead | {"bytes": size}), "triples")
    sample = triples.where("pos % 3 <> 0")
    names = in_order(sample.groupBy("name", "n1", "n2").agg(F.count("*").alias("times"), F.max("bytes").alias("covers")), ["name", "n1", "n2"], "names")
    named = sample.join(names.select("name", "n1", "n2", F.col("mid").alias("rank")), ["name", "n1", "n2"])
    deeper = None
    if known < names_needed and not names.where((F.col("times") > 1) & (F.col("covers") < need) & (F.col("n2") != 0)).isEmpty():
        shorter = named.select(
            F.struct("run", (F.col("pos") % 3).alias("residue")).alias("run"), F.floor(F.col("pos") / 3).cast("int").alias("pos"),
            (F.col("rank") + 1).alias("name"), F.col("bytes").alias("size"),
        )
        deeper = suffix_order(shorter, need, names_needed, 3 * known)
        ranks = deeper.select(F.col("run.run").alias("run"), (F.col("pos") * 3 + F.col("run.residue")).cast("int").alias("pos"), (F.col("mid") + 1).alias("rank"))
    else:
        ranks = named.select("run", "pos", (F.col("rank") + 1).alias("rank"))
    ranked = triples.repartition("run").join(ranks.repartition("run"), ["run", "pos"], "left")  # dealt once, by run
    ranked = ranked.withColumns({"r1": F.lead("rank", 1, 0).over(by), "r2": F.lead("rank", 2, 0).over(by)})
    ranked = cut(ranked, "ranked", more=BY_PART_OF_KEY)
    drop_scratch(spark, triples, names, *([deeper] if deeper is not None else []))
    rest = F.col("pos") % 3 == 0
    first = in_order(ranked.where("pos % 3 <> 2").select("run", "pos", "name", "r1", "rank", rest.alias("rest")), ["name", "r1", "run", "pos"], "merge")
    second = in_order(ranked.where("pos % 3 <> 1").select("run", "pos", "name", "n1", "r2", "rank", rest.alias("rest")), ["name", "n1", "r2", "run", "pos"], "merge")
    one = running_count(first, "rest", "k").select("run", "pos", "k", "rest", "rank")
    two = running_count(second, "rest", "k").where("NOT rest").select("run", "pos", "k", "rest", "rank")
    # the k-th remaining suffix follows all sampled ones that have k remaining suffixes before them
    order = in_order(one.union(two), ["k", "rest", "rank", "run", "pos"], "suffixes").select("run", "pos", "mid")
    drop_scratch(spark, ranked, first, second)
    return order
