"""Ranked lexical search by dense blocked matrix products.

Documents are tokenised once against the compact vocabulary of the items; what is kept of each is its length and its
counts of those terms. From the sums over all documents come integer impacts. Tasks fill tiles (documents x terms) with
impacts and multiply them by tiles (terms x items) with counts, in float64: every term slice is cut so that partial sums
stay below 2^53, so products are exact whatever the order of additions, and slices add up in 64-bit integers. Each tile
keeps its best rows with ties settled by doc_id, and tasks' best rows are ranked in two steps.

Items go in groups whose vocabulary is bounded, one pass over the documents each; a benchmark is one group.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.llm.common import LOWER, UPPER, cut, drop_scratch, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 20
#: Distinct terms and items of a group, on average: what a task holds of the items.
GROUP_TERMS, GROUP_ITEMS = 200_000, 2_000
#: Items of a tile, and numbers of a document tile.
TILE_ITEMS, TILE_CELLS = 256, 2_000_000
#: Largest sum that float64 adds exactly.
EXACT = 2**53
#: Rows of an item that are ranked in one task at first: one of so many parts.
RANK_PARTS = 64
BATCH_DOCUMENTS = 2_000
_LOWERED = str.maketrans(UPPER, LOWER)


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWERED))


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


@dataclass
class ItemTile:
    """Some items over their own vocabulary: columns are the term numbers, counts are terms x items, slices of which
    each keep partial sums below EXACT."""

    first: int
    columns: np.ndarray
    slices: list[tuple[np.ndarray, np.ndarray]]


def item_tiles(items: list[Counter], numbers: dict[str, int], most: int) -> list[ItemTile]:
    """Tiles of the items; most: the largest impact of any term in any document."""
    tiles = []
    room = max(1, (EXACT - 1) // max(1, most))  # the sum of counts that a slice may hold for an item
    for first in range(0, len(items), TILE_ITEMS):
        part = items[first : first + TILE_ITEMS]
        columns = np.array(sorted({numbers[t] for x in part for t in x}), np.int64)
        place = {c: k for k, c in enumerate(columns.tolist())}
        counts = np.zeros((len(columns), len(part)), np.int64)
        for j, x in enumerate(part):
            for t, q in x.items():
                counts[place[numbers[t]], j] = q
        tiles.append(ItemTile(first, columns, cut_slices(counts, room)))
    return tiles


def cut_slices(counts: np.ndarray, room: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and float64 counts of slices that add up to counts, no column sum of a slice being above room."""
    slices, left = [], counts.copy()
    while left.any():
        before = np.cumsum(left, 0) - left
        take = np.clip(room - before, 0, left)
        rows = np.flatnonzero(take.any(1))
        slices.append((rows, take[rows].astype(np.float64)))
        left = left - take
    return slices


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Rows of the top scores above 0, ties by ascending id."""
    found = np.flatnonzero(scores > 0)
    if len(found) > top:
        floor = np.partition(scores[found], len(found) - top)[len(found) - top]
        found = found[scores[found] >= floor]  # all ties with the last
    return found[np.lexsort((ids[found], -scores[found]))][:top]


def _counted(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """doc_id, n (terms), ids and tfs (of the numbered terms) of documents that have terms."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # GROUP_TERMS on average

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            kept, n, ids, tfs = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                terms = terms_of(text.as_py())
                if terms:
                    own = Counter(known[t] for t in terms if t in known)
                    kept.append(k)
                    n.append(len(terms))
                    ids.append(list(own.keys()))
                    tfs.append(list(own.values()))
            own_ids = batch.column("doc_id").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([own_ids, pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


def _searched(counted: DataFrame, tiles: list[ItemTile], weights: np.ndarray, n_documents: int, n_terms: int, top: int) -> DataFrame:
    """item (its number in the group), doc_id, score: the best rows of each task."""
    shared = counted.sparkSession.sparkContext.broadcast((tiles, weights))
    last = np.iinfo(np.int64).max  # null ids come after all others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, weights = shared.value
        width = max((len(t.columns) for t in tiles), default=1)
        rows = max(1, TILE_CELLS // max(1, width))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column("doc_id").fill_null(last).to_numpy(zero_copy_only=False)
                n = part.column("n").to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(n)), pa.compute.list_value_length(part.column("ids")).to_numpy(zero_copy_only=False))
                term, tf = part.column("ids").flatten().to_numpy(zero_copy_only=False), part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                m = 75 + (25 * n * n_documents) // max(1, n_terms)
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[of]))
                for tile in tiles:
                    place = np.searchsorted(tile.columns, term)
                    mine = place < len(tile.columns)
                    mine[mine] = tile.columns[place[mine]] == term[mine]
                    if not mine.any():
                        continue
                    own, back = np.unique(of[mine], return_inverse=True)  # documents with a term of the tile
                    dense = np.zeros((len(own), len(tile.columns)))
                    dense[back, place[mine]] = impact[mine]
                    scores = sum(np.rint(dense[:, r] @ c).astype(np.int64) for r, c in tile.slices)
                    for j in range(scores.shape[1]):
                        item, now = tile.first + j, best(scores[:, j], ids[own], top)
                        if len(now):
                            old = held.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                            s, i = np.concatenate((old[0], scores[now, j])), np.concatenate((old[1], ids[own][now]))
                            first = best(s, i, top)
                            held[item] = (s[first], i[first])
        for item, (s, i) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), item), pa.int32()), pa.array(i, pa.int64(), mask=i == last), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The top rows of each item with rank, in two steps, so that no task ranks what all tasks found for an item."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(RANK_PARTS))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    return few.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item with a score above 0, as a table.

    A null or empty text has no terms: as a document it is not counted, as an item it finds nothing. Equal rows of items
    are answered once; different texts under one item_id are ranked each on its own. Equal rows of docs are documents of
    their own; equal scores go by doc_id, null ids last. Other columns are not read. Long texts count whole.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", "text").where(F.length("text") > 0).distinct()
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("words")).first()
    groups = max(1, math.ceil(size["n"] / GROUP_ITEMS), math.ceil((size["words"] or 0) / GROUP_TERMS))
    out = None
    for g in range(groups):
        got = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()  # bounded as GROUP_TERMS and GROUP_ITEMS say
        counts = [Counter(terms_of(r["text"])) for r in got]
        numbers = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        counted = cut(_counted(docs, numbers), "counted", BATCH_DOCUMENTS)
        whole = counted.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        n_documents, n_terms = whole["n"], whole["terms"] or 0
        weights = np.zeros(len(numbers), np.int64)
        for r in counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():  # a number for each term of the group
            weights[r["id"]] = weight(n_documents, r["df"])
        most = int(weights.max(initial=0)) * 1_000_000  # tf / (1000 tf + ...) is below 1 / 1000
        found = _ranked(_searched(counted, item_tiles(counts, numbers, most), weights, n_documents, n_terms, top), top)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(got)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = cut(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked", BATCH_DOCUMENTS)
        drop_scratch(spark, counted)
        out = part if out is None else out.union(part)
    return out


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best TOP of all `documents` for each `benchmark` item: see search() for nulls, empty and long texts, ties,
    repeated rows and other columns. An empty table on either side gives no rows."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT r, doc_id, term,
        CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
      FROM p JOIN df USING (term), s WHERE term IN (SELECT term FROM q)),
t AS (SELECT item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM t WHERE score > 0) WHERE rank <= 20
"""
