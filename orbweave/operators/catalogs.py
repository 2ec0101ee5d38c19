"""Catalogs of diagnostic states: content hashes, ranks, bins, quotas, splits, quantiles and gates.

Under the test binding an order is a state, its customer's nation group an instance, and its line items are actions
with their prices as values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.functions.exprs import stable_seed
from orbweave.plans.ordering import ranked
from orbweave.tables import Scenarios


def states(t: Scenarios) -> DataFrame:
    """state_id, instance, family, step, state_hash (SHA-256 of a flat string)."""
    o = t.raw("orders")
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("state_id"), (F.col("o_custkey") % 7).alias("instance"), F.col("o_orderstatus").alias("family"),
        (F.col("o_orderkey") % 40).alias("step"), F.sha2(text, 256).alias("state_hash"),
    )


def actions(t: Scenarios) -> DataFrame:
    """state_id, action (a flat string), q: each distinct action once, the largest value where it repeats."""
    line = t.raw("lineitem")
    action = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return line.groupBy(F.col("l_orderkey").alias("state_id"), action.alias("action")).agg(F.max("l_extendedprice").alias("q"))


def hash_rank(df: DataFrame, keys: list[str], *parts) -> DataFrame:
    """rank of each row within keys by the SHA-256 of its parts, then by the parts themselves."""
    text = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    return ranked(df, keys, {"hash": F.sha2(text, 256), "text": text}, "rank")


def rank_bins(df: DataFrame, keys: list[str], column: str, tie: str, bins: int) -> DataFrame:
    """bin of each row: floor(index * bins / n) of its place by column."""
    out = ranked(df, keys, {"column": F.col(column), "tie": F.col(tie)}, "__rank", "__count")
    return out.withColumn("bin", F.floor((F.col("__rank") - 1) * bins / F.col("__count")).cast("long")).drop("__rank", "__count")


def balanced_quotas(categories: DataFrame, key: str, total: int) -> DataFrame:
    """total spread evenly over categories, the remainder to the first ones."""
    n = F.broadcast(categories.agg(F.count("*").alias("n")))  # one row
    place = F.row_number().over(Window.orderBy(key)) - 1  # a handful of categories
    return categories.withColumn("i", place).crossJoin(n).select(key, (F.floor(F.lit(total) / F.col("n")) + (F.col("i") < total % F.col("n")).cast("int")).cast("long").alias("quota"))


def state_selection(spark, sf_dir: str) -> DataFrame:
    """Per instance the first states by content hash, as many as its quota."""
    s = states(Scenarios(spark, sf_dir))
    quota = balanced_quotas(s.select("instance").distinct(), "instance", 100)
    return hash_rank(s, ["instance"], "state_hash").join(quota, "instance").where("rank <= quota").select("instance", "state_id", F.col("rank").cast("int").alias("rank"))


def query_prefix(spark, sf_dir: str) -> DataFrame:
    """Per state the observed action (largest value), then others by hash, up to four."""
    a = actions(Scenarios(spark, sf_dir))
    by = Window.partitionBy("state_id")
    best = F.row_number().over(by.orderBy(F.desc("q"), "action")) == 1
    a = a.withColumn("observed", best)
    text = F.concat_ws("|", F.col("state_id").cast("string"), "action")
    order = by.orderBy(F.when(F.col("observed"), 0).otherwise(1), F.sha2(text, 256), "action")
    return a.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 4).select("state_id", "action", "observed", "place")


def candidate_bins(spark, sf_dir: str) -> DataFrame:
    """Number of states in each bin of candidate counts and of steps."""
    t = Scenarios(spark, sf_dir)
    n = actions(t).groupBy("state_id").agg(F.count("*").alias("candidates"))
    s = states(t).join(n, "state_id")
    s = rank_bins(s, ["instance"], "candidates", "state_id", 4)
    s = s.join(s.groupBy("instance").agg(F.max("step").alias("last")), "instance")
    s = s.withColumn("time_bin", F.floor(F.col("step") * 3 / (F.col("last") + 1)).cast("long"))
    return s.groupBy("instance", "bin", "time_bin").agg(F.count("*").alias("states"))


def state_q_summary(spark, sf_dir: str) -> DataFrame:
    """Quantiles of the values of each state, linear between ranks, and whether their spread is wide."""
    q = actions(Scenarios(spark, sf_dir)).groupBy("state_id").agg(
        F.min("q").alias("q_min"), F.percentile("q", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.max("q").alias("q_max"), F.count("*").alias("n")
    )
    spread = F.col("p")[2] - F.col("p")[0]
    cols = [F.round(F.col("p")[i], 4).alias(name) for i, name in enumerate(("p10", "p50", "p90"))]
    return q.select("state_id", "n", "q_min", *cols, "q_max", F.round(spread, 4).alias("spread"), (spread >= 30000).alias("wide"))


def spread_gate(spark, sf_dir: str) -> DataFrame:
    """Per instance and overall: states, wide ones, and whether at least half are wide, by integers."""
    t = Scenarios(spark, sf_dir)
    s = state_q_summary(spark, sf_dir).join(states(t).select("state_id", "instance"), "state_id")
    g = s.where("n >= 2").rollup("instance").agg(F.count("*").alias("states"), F.count_if("wide").alias("wide"))
    return g.select(F.coalesce(F.col("instance").cast("string"), F.lit("all")).alias("instance"), "states", "wide", (F.col("wide") * 100 >= F.col("states") * 50).alias("pass"))


def inventory(spark, sf_dir: str) -> DataFrame:
    """States by thresholds of candidates, in all and per instance, in one pass."""
    t = Scenarios(spark, sf_dir)
    n = actions(t).groupBy("state_id").agg(F.count("*").alias("c"))
    s = states(t).join(n, "state_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    counts = [F.count_if(F.col("c") >= k).alias(f"at_least_{k}") for k in (1, 2, 4, 8)]
    return s.rollup("instance").agg(F.count("*").alias("states"), *counts).select(
        F.coalesce(F.col("instance").cast("string"), F.lit("all")).alias("instance"), "states", *[f"at_least_{k}" for k in (1, 2, 4, 8)]
    )


def selection_marginals(spark, sf_dir: str) -> DataFrame:
    """States by instance, by family and by step group, from one pass of grouping sets."""
    s = states(Scenarios(spark, sf_dir)).withColumn("phase", F.floor(F.col("step") / 10).cast("string")).withColumn("instance", F.col("instance").cast("string"))
    g = s.groupingSets([["instance"], ["family"], ["phase"]], "instance", "family", "phase").agg(F.count("*").alias("states"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "instance").when(F.col("g") == 5, "family").otherwise("phase")
    return g.select(kind.alias("dimension"), F.coalesce("instance", "family", "phase").alias("value"), "states")


def candidate_set_hashes(spark, sf_dir: str) -> DataFrame:
    """Hash of each state's actions by value and of their set, whatever the order."""
    a = actions(Scenarios(spark, sf_dir))
    g = a.groupBy("state_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("q"), "action"))).alias("by_value"), F.array_sort(F.collect_list("action")).alias("members"))
    ordered = F.array_join(F.transform("by_value", lambda x: x["action"]), ",")
    return g.select("state_id", F.sha2(ordered, 256).alias("ordered_hash"), F.sha2(F.array_join("members", ","), 256).alias("member_hash"))


def hash_split(spark, sf_dir: str) -> DataFrame:
    """Train or held out by MD5 bucket (F18), and an exact split by hash order (F19); a stable seed of each."""
    s = states(Scenarios(spark, sf_dir))
    text = F.concat_ws("|", F.lit("split"), F.col("state_id").cast("string"))
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100
    s = ranked(s, ["instance"], {"hash": F.md5(text), "id": F.col("state_id")}, "place", "n")
    place, n = F.col("place"), F.col("n")
    exact = F.when(place <= F.floor(n * 6 / 10), "train").when(place <= F.floor(n * 8 / 10), "dev").otherwise("test")
    return s.select("state_id", stable_seed(text).alias("seed"), F.when(bucket < 10, "held_out").otherwise("train").alias("split"), exact.alias("exact_split"))


def digest_tree(rows: DataFrame, keys: list[str], text) -> DataFrame:
    """Per keys: rows and digest, the SHA-256 of the set of texts with their repeats, whatever their order. Texts are hashed,
    dealt by three digits of that, and the sorted hashes of each part are hashed, then those of the parts: no list is longer
    than a 4,096th of the rows of its keys, or 4,096 parts. Null texts count as empty."""
    leaf = F.sha2(F.coalesce(text, F.lit("")), 256)
    parts = rows.select(*keys, leaf.alias("leaf")).groupBy(*keys, F.substring("leaf", 1, 3).alias("part")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("leaf")).alias("x"))
    parts = parts.select(*keys, "n", F.concat("part", F.sha2(F.array_join("x", ","), 256)).alias("h"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("digest"))


def results_hash(spark, sf_dir: str) -> DataFrame:
    """Hash of each instance's results (E28): states, actions and values alone, once for each state and action, so that the
    order of runs, repeated runs and what came from a cache make no difference."""
    t = Scenarios(spark, sf_dir)
    a = actions(t).join(states(t).select("state_id", "instance", "state_hash"), "state_id")
    return digest_tree(a, ["instance"], F.concat_ws("|", "state_hash", "action", F.round(F.col("q") * 100).cast("long").cast("string")))


def result_integrity(spark, sf_dir: str) -> DataFrame:
    """Planned queries against results by key: planned without result, result without plan, repeated results."""
    t = Scenarios(spark, sf_dir)
    planned = t.raw("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("planned")).distinct()
    got = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("results"))
    both = planned.join(got, "k", "full")
    status = F.when(F.col("planned").isNull(), "unknown").when(F.col("results").isNull(), "missing").when(F.col("results") > 1, "repeated").otherwise("ok")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("keys"))


_S = """WITH s AS (SELECT o_orderkey AS state_id, o_custkey % 7 AS instance, o_orderstatus AS family, o_orderkey % 40 AS step,
 sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS state_hash FROM orders),
a AS (SELECT l_orderkey AS state_id, l_partkey || '|' || l_suppkey AS action, max(l_extendedprice) AS q FROM lineitem GROUP BY ALL)"""
_Q = """, z AS (SELECT state_id, count(*) AS n, min(q) AS q_min, quantile_cont(q, 0.1) AS p1, quantile_cont(q, 0.5) AS p5, quantile_cont(q, 0.9) AS p9, max(q) AS q_max FROM a GROUP BY state_id)"""

QUERIES = {
    "results_hash": (
        results_hash,
        _S + """, l AS (SELECT instance, sha256(state_hash || '|' || action || '|' || CAST(round(q * 100) AS BIGINT)) AS leaf FROM a JOIN s USING (state_id)),
        p AS (SELECT instance, count(*) AS n, substr(leaf, 1, 3) || sha256(string_agg(leaf, ',' ORDER BY leaf)) AS h FROM l GROUP BY instance, substr(leaf, 1, 3))
        SELECT instance, CAST(sum(n) AS BIGINT) AS "rows", sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM p GROUP BY instance""",
    ),
    "state_selection": (
        state_selection,
        _S + """, c AS (SELECT instance, row_number() OVER (ORDER BY instance) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT instance FROM s))
        SELECT instance, state_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY instance ORDER BY sha256(state_hash), state_hash) AS INTEGER) AS rank FROM s)
        JOIN c USING (instance) WHERE rank <= 100 // n + CASE WHEN i < 100 % n THEN 1 ELSE 0 END""",
    ),
    "query_prefix": (
        query_prefix,
        _S + """ SELECT state_id, action, observed, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY state_id ORDER BY CASE WHEN observed THEN 0 ELSE 1 END, sha256(state_id || '|' || action), action) AS INTEGER) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY q DESC, action) = 1 AS observed FROM a)) WHERE place <= 4""",
    ),
    "candidate_bins": (
        candidate_bins,
        _S + """ SELECT instance, bin, time_bin, count(*) AS states FROM (SELECT instance, (row_number() OVER (PARTITION BY instance ORDER BY c, state_id) - 1) * 4 // count(*) OVER (PARTITION BY instance) AS bin,
        step * 3 // (max(step) OVER (PARTITION BY instance) + 1) AS time_bin FROM s JOIN (SELECT state_id, count(*) AS c FROM a GROUP BY 1) USING (state_id)) GROUP BY ALL""",
    ),
    "state_q_summary": (
        state_q_summary,
        _S + _Q + " SELECT state_id, n, q_min, round(p1, 4) AS p10, round(p5, 4) AS p50, round(p9, 4) AS p90, q_max, round(p9 - p1, 4) AS spread, p9 - p1 >= 30000 AS wide FROM z",
    ),
    "spread_gate": (
        spread_gate,
        _S + _Q + """ SELECT coalesce(CAST(instance AS VARCHAR), 'all') AS instance, count(*) AS states, count(*) FILTER (p9 - p1 >= 30000) AS wide, count(*) FILTER (p9 - p1 >= 30000) * 100 >= count(*) * 50 AS pass
        FROM z JOIN s USING (state_id) WHERE n >= 2 GROUP BY ROLLUP (instance)""",
    ),
    "inventory": (
        inventory,
        _S + " SELECT coalesce(CAST(instance AS VARCHAR), 'all') AS instance, count(*) AS states, " + ", ".join(f"count(*) FILTER (coalesce(c, 0) >= {k}) AS at_least_{k}" for k in (1, 2, 4, 8))
        + " FROM s LEFT JOIN (SELECT state_id, count(*) AS c FROM a GROUP BY 1) USING (state_id) GROUP BY ROLLUP (instance)",
    ),
    "selection_marginals": (
        selection_marginals,
        _S + """ SELECT 'instance' AS dimension, CAST(instance AS VARCHAR) AS value, count(*) AS states FROM s GROUP BY ALL UNION ALL SELECT 'family', family, count(*) FROM s GROUP BY ALL
        UNION ALL SELECT 'phase', CAST(step // 10 AS VARCHAR), count(*) FROM s GROUP BY ALL""",
    ),
    "candidate_set_hashes": (
        candidate_set_hashes,
        _S + " SELECT state_id, sha256(string_agg(action, ',' ORDER BY q DESC, action)) AS ordered_hash, sha256(string_agg(action, ',' ORDER BY action)) AS member_hash FROM a GROUP BY state_id",
    ),
    "hash_split": (
        hash_split,
        _S + """, h AS (SELECT *, md5('split|' || state_id) AS m FROM s) SELECT state_id, CAST(CAST('0x' || substr(m, 1, 8) AS BIGINT) & 2147483647 AS BIGINT) AS seed,
        CASE WHEN CAST('0x' || substr(m, 1, 8) AS BIGINT) % 100 < 10 THEN 'held_out' ELSE 'train' END AS split,
        CASE WHEN p <= n * 6 // 10 THEN 'train' WHEN p <= n * 8 // 10 THEN 'dev' ELSE 'test' END AS exact_split
        FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY m, state_id) AS p, count(*) OVER (PARTITION BY instance) AS n FROM h)""",
    ),
    "result_integrity": (
        result_integrity,
        """SELECT CASE WHEN p IS NULL THEN 'unknown' WHEN r IS NULL THEN 'missing' WHEN r > 1 THEN 'repeated' ELSE 'ok' END AS status, count(*) AS keys
        FROM (SELECT DISTINCT o_orderkey AS k, 1 AS p FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT l_orderkey AS k, count(*) AS r FROM lineitem GROUP BY 1) USING (k) GROUP BY 1""",
    ),
}
