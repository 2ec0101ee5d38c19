"""Uniform sharding by a hypergeometric communication matrix.

Rows sit in P blocks (hash of their identity). The counts that each block sends to each target cell are drawn
from the multivariate hypergeometric law, given the block sizes and the wanted cell sizes: exactly the law that a
uniform random permutation induces. Each block permutes its rows and deals them out by those counts, and each
cell permutes what it got. A cell is a part of a shard, so no task holds a whole shard when shards are large.

The driver sees P counts and draws a matrix of at most MAX_ENTRIES numbers; both are bounded whatever the input.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a block or a cell should hold at most, while the matrix stays below MAX_ENTRIES.
BLOCK_ROWS = 20_000
MIN_BLOCKS = 64
MAX_BLOCKS = 2_000
MAX_ENTRIES = 4_000_000


def draw_hypergeometric(rng: random.Random, good: int, total: int, n: int) -> int:
    """Good items among n drawn without replacement out of total: inversion outwards from the mode."""
    low, high = max(0, n - (total - good)), min(n, good)
    if low == high:
        return low

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    p = math.exp(log_choose(good, mode) + log_choose(total - good, n - mode) - log_choose(total, n))
    left = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (total - good - n + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (total - good - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix with these margins, as a uniform permutation would give it."""
    rng = random.Random(seed)
    free, open_total = list(columns), sum(columns)
    matrix = []
    for need in rows:
        line, rest, pool = [], need, open_total
        for k, m in enumerate(free):
            got = draw_hypergeometric(rng, m, pool, rest)
            line.append(got)
            pool -= m
            rest -= got
            free[k] = m - got
        open_total -= need
        matrix.append(line)
    return matrix


def shard_uniform(df: DataFrame, n_shards: int, identity: list[str], seed: int = 17) -> DataFrame:
    """Every row with `shard` (0 to n_shards - 1) and `slot` (its place in the shard, gapless from 0).

    Shard sizes differ by one at most, and every assignment with these sizes is equally likely. identity: columns
    (of hashable types) that name a row; equal rows are interchangeable, nulls count as values. Columns `shard` and
    `slot` of the input are replaced. An empty input gives an empty result.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    ids = [F.col(f"`{c}`") for c in identity]
    n = df.count()
    blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, n // BLOCK_ROWS))
    per_shard = max(1, min(math.ceil(n / n_shards / BLOCK_ROWS), MAX_ENTRIES // (blocks * n_shards)))
    block = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(blocks)).cast("int")
    counts = {r["b"]: r["n"] for r in df.groupBy(block.alias("b")).agg(F.count("*").alias("n")).collect()}
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    cells = [sizes[s] // per_shard + (q < sizes[s] % per_shard) for s in range(n_shards) for q in range(per_shard)]
    order = sorted(counts)
    sent = []
    for b, line in zip(order, communication_matrix([counts[b] for b in order], cells, seed)):
        upto, ends = 0, []
        for c in line:
            upto += c
            ends.append(upto)
        sent.append((b, ends))
    ends = F.broadcast(spark.createDataFrame(sent, "__b int, __ends array<bigint>"))  # at most MAX_ENTRIES numbers

    def rank(part: str, salt: int):
        return F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + salt), *ids), *ids)) - 1

    dealt = (
        df.withColumn("__b", block)
        .withColumn("__r", rank("__b", 1))
        .join(ends, "__b")
        .withColumn("__cell", F.size(F.filter("__ends", lambda e: e <= F.col("__r"))))
        .drop("__ends", "__b", "__r")
    )
    size = F.lit(n // n_shards) + (F.col("shard") < n % n_shards).cast("int")
    part = F.col("__cell") % per_shard
    base = part * F.floor(size / per_shard) + F.least(part, size % per_shard)
    return (
        dealt.withColumn("__p", rank("__cell", 2))
        .withColumn("shard", F.floor(F.col("__cell") / per_shard).cast("int"))
        .withColumn("slot", (base + F.col("__p")).cast("long"))
        .drop("__cell", "__p")
    )


def op1_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """`documents` in 24 shards under the law `rows`; a null text has no bytes, so size 8 and checksum 0."""
    from orbweave.llm.common import table

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_uniform(docs, 24, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
