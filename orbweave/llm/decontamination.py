"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is WINDOW consecutive item words (an item with fewer words is one window). Both sides keep the smallest
k-gram hash of each run of w consecutive k-grams, with k + w - 1 = window length, so two equal windows always
share a kept hash. The kept hashes are joined, and each hit is extended to the windows around it, which must equal
a window of the item word by word. Texts are keyed by their MD5, so copies of a text are settled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ascii_lower, cut, drop_scratch, table

#: Every character outside the word class, for texts whose ASCII letters are of one case or not.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
#: Fingerprints (16 bytes each) that may be broadcast, those of the benchmark or those hit; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def raw_words(text: Column) -> Column:
    """Words in the case they have; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def words_of(text: Column) -> Column:
    return raw_words(ascii_lower(text))


def _upto(last: Column) -> Column:
    """0, 1, ... last; nothing when last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def word_hashes(text: Column) -> Column:
    """One hash per word. upper() maps each character alone and merges no less than A-Z lower-casing does, so equal
    words have equal hashes; the few further words that it merges fall out when windows are compared."""
    return F.transform(raw_words(F.upper(text)), lambda x: F.xxhash64(x))


def _gram_hashes(hashes: Column, length: int) -> Column:
    """Hash of each k-gram, from word hashes; the window length is hashed too, so lengths never mix."""
    k = _shape(length)[0]
    return F.transform(_upto(F.size(hashes) - k), lambda i: F.xxhash64(F.lit(length), *[F.get(hashes, i + j) for j in range(k)]))


def _gram_hashes_of(text: Column, length: int) -> Column:
    return let(word_hashes(text), lambda hashes: _gram_hashes(hashes, length))


def _winnowed(grams: Column, length: int) -> Column:
    w = _shape(length)[1]
    if w == 1:
        return F.array_distinct(grams)
    return F.array_distinct(F.transform(_upto(F.size(grams) - w), lambda i: F.array_min(F.slice(grams, i + 1, w))))


def _shape(length: int) -> tuple[int, int]:
    """k and w for windows of a length: k + w - 1 = length."""
    k = GRAM if length == WINDOW else length
    return k, length - k + 1


def fingerprints(text: Column, lengths: list[int]) -> Column:
    """The kept hashes of a text for all window lengths."""

    def kept(hashes: Column, length: int) -> Column:
        return let(_gram_hashes(hashes, length), lambda grams: _winnowed(grams, length))

    return let(word_hashes(text), lambda hashes: F.concat(*[kept(hashes, m) for m in lengths]))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, words, length) per item with words, length being that of its windows."""
    return (
        benchmark.select("item_id", "text", words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("length", F.least(F.size("words"), F.lit(WINDOW)))
    )


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per distinct text with a benchmark window: text_key (MD5), n_hit, n_items, item_ids (sorted strings), as a table.

    documents needs `text`; benchmark needs `item_id` and `text`. Null and empty texts have no words. Items without
    an id count as items, but do not appear in item_ids. Repeated items and documents give the same rows once.
    """
    spark = documents.sparkSession
    items = benchmark_windows(benchmark)
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # 1 to WINDOW at most
    if not lengths:
        return spark.createDataFrame([], "text_key string, n_hit long, n_items long, item_ids array<string>")
    kept = None
    for m in lengths:
        part = items.where(F.col("length") == m).select(F.explode(fingerprints(F.col("text"), [m])).alias("fp"))
        kept = part if kept is None else kept.union(part)
    kept = kept.distinct()
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)

    texts = documents.select(F.col("text").alias("t"), F.md5(F.col("text").cast("binary")).alias("text_key")).where(F.length("t") > 0)
    hits = texts.select("text_key", F.explode(fingerprints(F.col("t"), lengths)).alias("fp")).join(kept, "fp", "left_semi")
    hits = cut(hits.select("text_key").distinct(), "hits")
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    # copies of a text are one row as soon as each task has read its part
    found = cut(texts.join(hits, "text_key", "left_semi").groupBy("text_key").agg(F.any_value("t").alias("t")), "hit-texts")
    windows = None
    for m in lengths:
        w = _shape(m)[1]
        grams = found.select("text_key", _gram_hashes_of(F.col("t"), m).alias("g")).select("text_key", F.size("g").alias("n"), F.posexplode("g").alias("p", "fp"))
        near = grams.join(kept, "fp", "left_semi").select("text_key", "n", F.explode(F.sequence(F.greatest(F.col("p") - (w - 1), F.lit(0)), "p")).alias("s"))
        starts = near.where(F.col("s") < F.col("n") - (w - 1)).groupBy("text_key").agg(F.collect_set("s").alias("starts"))  # no more than a text has words
        window = let(
            words_of(F.col("t")),
            lambda words: F.transform(
                "starts", lambda s: F.struct(s.alias("at"), F.concat_ws(" ", F.slice(words, s + 1, m)).alias("window"))
            ),
        )
        part = found.join(starts, "text_key").select("text_key", F.lit(m).alias("length"), F.explode(window).alias("x"))
        windows = part if windows is None else windows.union(part)
    wanted = items.select(
        "item_id",
        "length",
        F.explode(
            F.transform(_upto(F.size("words") - F.col("length")), lambda i: F.concat_ws(" ", F.slice("words", i + 1, F.col("length"))))
        ).alias("window"),
    ).distinct()
    matched = windows.select("text_key", "length", "x.at", "x.window").join(wanted, ["length", "window"])
    matched = cut(matched.select("text_key", "length", "at", "item_id").distinct(), "matched")
    covered = (
        matched.select("text_key", "at", "length")
        .distinct()
        .select("text_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("word"))
        .distinct()
        .groupBy("text_key")
        .agg(F.count("*").alias("n_hit"))
    )
    per_item = (
        matched.select("text_key", "item_id")
        .distinct()
        .groupBy("text_key")
        .agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    out = cut(covered.join(per_item, "text_key"), "contaminated")
    drop_scratch(spark, found, matched)
    return out


def _small(found: DataFrame) -> DataFrame:
    """found to be broadcast where its ids are few; otherwise it is joined by a shuffle, whose hot keys Spark splits."""
    size = found.agg(F.sum(F.size("item_ids") + 4)).first()[0] or 0
    return F.broadcast(found) if size <= BROADCAST_ROWS else found


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark window.

    Null and empty texts stay, repeated rows stay or go together, and columns of any name come back, since a row
    travels as one struct. No items remove nothing.
    """
    hit = _small(contamination(documents, benchmark)).select("text_key")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = documents.select(key.alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.join(hit, "text_key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def op8_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in all `documents`: a null text has no words; the rest as in contamination()."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = _small(contamination(docs, bench))
    return (
        docs.select(
            "doc_id",
            F.size(raw_words(F.col("text"))).cast("long").alias("n_words"),
            F.md5(F.col("text").cast("binary")).alias("text_key"),
        )
        .join(found, "text_key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", F.coalesce("item_ids", F.array().cast("array<string>"))), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, w, least(len(w), 10) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g
       FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM i)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, m, s, array_to_string(w[s:s + m - 1], ' ') AS g
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT r, s, m, item_id FROM dw JOIN iw USING (m, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT r, s, m FROM hit)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
