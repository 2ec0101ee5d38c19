"""Removal of repeated byte strings by suffix sorting.

A byte goes when a string of LENGTH bytes that covers it also starts somewhere else. Texts are cut into phrases at
anchors (the rightmost smallest hash of each window of WINDOW grams), which any two equal strings of LENGTH bytes
share inside. Phrases that occur once end sequences, as no repeated string spans them whole; the sequences of the
others are suffix sorted by the difference-cover algorithm of suffix_array. Adjacent suffixes are compared by their
first phrases: an anchor whose neighbours share too few is out. The partial phrases at both ends of a string cannot
be seen there, so an exact comparison of the strings follows: all those of an anchor's stretch at once, then blocks
of those that are equally far from their anchor, then single ones, each time only where the coarser step left it
open. Equal texts are one text with a multiplicity from the start.

Equality is that of 128-bit hashes of the bytes (of texts and of strings), and phrases are told apart by 63 bits: two
equal phrase names only let an anchor through to the exact comparison, never past it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import cut, drop_scratch, table
from orbweave.llm.suffix_array import BY_PART_OF_KEY, in_order, suffix_order, with_neighbours

LENGTH = 400
WINDOW = 192
GRAM = 16
#: Names up to which the suffix order must hold, and phrases by which neighbours in it are compared.
ORDERED, COMPARED = 9, 3
#: Strings that are equally far from their anchor, compared together: first in blocks of this width, then alone.
WIDTHS = (16, 1)
BATCH_DOCUMENTS = 500
#: Numbers about texts (ids, anchors, spans) that may be broadcast to meet the texts; more are joined by a shuffle.
BROADCAST_NUMBERS = 4_000_000

_LOW = np.uint64(0xFFFFFFFF)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Text:
    """Anchors and stretches of one text's bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.n = raw, len(raw)
        x = _BYTES[np.frombuffer(raw, np.uint8)]
        with np.errstate(over="ignore"):
            h, s, m = x, 1, _MULTIPLIER
            while s < GRAM:
                h, s, m = h[:-s] * m + h[s:], s * 2, m * m
            v = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
            s = 1
            while s * 2 <= WINDOW:
                v, s = np.minimum(v[:-s], v[s:]), s * 2
            if s < WINDOW:
                v = np.minimum(v[: len(v) - (WINDOW - s)], v[WINDOW - s :])
        every = (_LOW - (v & _LOW)).astype(np.int64)
        of_start = every[: self.n - LENGTH + 1]
        self.low = np.concatenate(([0], np.flatnonzero(np.diff(of_start)) + 1))  # starts low..high have anchor at
        self.high = np.concatenate((self.low[1:] - 1, [len(of_start) - 1]))
        self.anchors = np.unique(every)
        self.at = of_start[self.low]
        self.index = np.searchsorted(self.anchors, self.at)
        inner = every[np.minimum(self.low + LENGTH - (WINDOW + GRAM - 1), len(every) - 1)]
        #: Whole phrases that any string of the stretch spans from its anchor on, at least.
        self.depth = np.maximum(np.searchsorted(self.anchors, inner) - self.index, 1)


def _key(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchored(docs: DataFrame) -> DataFrame:
    """doc_id, key (128-bit hash of the bytes), n, sha of each row; names, sizes, depths of phrases (none if n < LENGTH)."""

    def run(frames):
        for pdf in frames:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                raw = _raw(text)
                names = sizes = depths = np.empty(0, np.int64)
                if len(raw) >= LENGTH:
                    t = Text(raw)
                    cuts = [*t.anchors.tolist(), t.n]
                    ends = np.array(cuts[1:], np.int64)
                    names = np.array([(xxhash.xxh3_64_intdigest(raw[i:j]) >> 1) or 1 for i, j in zip(cuts, cuts[1:])], np.int64)  # above the end mark, 0
                    sizes = ends - t.anchors
                    depths = np.zeros(len(names), np.int64)
                    depths[t.index] = t.depth
                rows.append((doc_id, _key(raw), len(raw), hashlib.sha256(raw).hexdigest(), names, sizes.astype(np.int32), depths.astype(np.int32)))
            out = pd.DataFrame(rows, columns=["doc_id", "key", "n", "sha", "names", "sizes", "depths"])
            out["doc_id"] = pdf["doc_id"].to_numpy()
            yield out

    schema = docs.select("doc_id").withColumns(
        {"key": F.lit(b""), "n": F.lit(0).cast("long"), "sha": F.lit(""), "names": F.array().cast("array<long>"), "sizes": F.array().cast("array<int>"), "depths": F.array().cast("array<int>")}
    ).schema
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _with_texts(docs: DataFrame, wanted: DataFrame, numbers: str, run, schema: str, name: str) -> DataFrame:
    """run(text bytes, wanted row) over the texts of wanted (key, rep, ...), as a table; numbers: SQL for what a row holds."""
    wanted = cut(wanted, "wanted")
    rows, size = wanted.agg(F.count("*"), F.sum(F.expr(f"2 + {numbers}"))).first()
    keep = [c for c in wanted.columns if c != "rep"]
    docs = docs.select("doc_id", F.col("text").alias("__text"))
    if (size or 0) <= BROADCAST_NUMBERS:
        joined = docs.join(F.broadcast(wanted), F.expr("doc_id <=> rep"))
    else:
        if rows <= BROADCAST_NUMBERS:
            docs = docs.join(F.broadcast(wanted.select("rep")), F.expr("doc_id <=> rep"), "left_semi")
        joined = docs.join(wanted, F.expr("doc_id <=> rep"))

    def each(frames):
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                raw = _raw(r.text_)
                if _key(raw) == r.key:  # ids may repeat with other texts
                    out += run(raw, r)
            yield pd.DataFrame(out, columns=names)

    made = cut(joined.select(F.col("__text").alias("text_"), *keep).mapInPandas(each, schema), name, BATCH_DOCUMENTS)
    drop_scratch(made.sparkSession, wanted)
    return made


def _piece(raw: bytes, at: int, low: int, high: int, near: int, far: int) -> tuple:
    """Of the strings that start at low to high, near to far bytes before their anchor: hash of the bytes that any
    string so far from its anchor has, and of all their bytes together."""
    return at, low, high, xxhash.xxh3_64_intdigest(raw[at - near : at - far + LENGTH]) - (1 << 63), _key(raw[low : high + LENGTH])


_PIECE = "tid long, weight int, at int, low int, high int, core long, whole binary"


def _settled(pieces: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans (tid, low, high) of pieces that occur twice as a whole, and what is open still.

    A piece whose core is nowhere else holds no repeated string. Where a core is shared by pieces that differ as a
    whole, some of their strings may be equal: these pieces, one of each kind, are to be cut finer.
    """
    kinds = pieces.groupBy("core", "whole").agg(F.sum("weight").alias("times"), F.min(F.struct("tid", "at", "low", "high")).alias("one"))
    kinds = cut(kinds, name)
    twice = kinds.where("times > 1").select("core", "whole")
    spans = cut(pieces.join(twice, ["core", "whole"], "left_semi").select("tid", "low", "high"), "settled")
    cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("lone")).where("kinds > 1 AND lone > 0")
    rest = kinds.join(cores.select("core"), "core", "left_semi")
    return spans, rest.select("one.*", F.least("times", F.lit(2)).cast("int").alias("weight"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Null and empty texts have no bytes and the digest of nothing. A row that occurs twice is repeated whole if it has
    LENGTH bytes. Rows with a null id are judged like others, and repeated ids may have different texts. Other columns
    are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    every = cut(_anchored(docs), "anchored", BATCH_DOCUMENTS)
    texts = (
        every.where(F.col("n") >= LENGTH)
        .groupBy("key")
        .agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.any_value("n").alias("n"),
            F.any_value("names").alias("names"), F.any_value("sizes").alias("sizes"), F.any_value("depths").alias("depths"),
        )
        .withColumn("tid", F.monotonically_increasing_id())
    )
    texts = cut(texts, "texts")
    phrase = (
        texts.select("tid", "copies", F.posexplode(F.arrays_zip("names", "sizes", "depths")).alias("s", "p"))
        .select("tid", "copies", "s", F.col("p.names").alias("name"), F.col("p.sizes").alias("size"), F.col("p.depths").alias("depth"))
    )
    common = phrase.groupBy("name").agg(F.sum(F.least("copies", F.lit(2))).alias("times")).where("times > 1").select("name")
    common = cut(common, "common")  # a table, so that the join below can split what a very frequent phrase gathers
    shared = phrase.join(common, "name", "left_semi").select("tid", "s", "name", "size", "depth")
    shared = shared.withColumn("g", F.col("s") - F.row_number().over(_by("tid", "s")))
    shared = shared.withColumn("pos", F.row_number().over(_by("tid", "g", "s")) - 1)
    shared = cut(shared.withColumn("run", F.struct("tid", "g")).drop("g"), "runs")
    drop_scratch(spark, common)
    order = suffix_order(shared.select("run", "pos", "name", "size"), LENGTH - WINDOW + 1, ORDERED)
    by = _by("run", "pos")
    ahead = {f"{c}{k}": F.lead(c, k, 0).over(by) for c in ("name",) for k in (1, 2)}
    looked = shared.repartition("run").withColumns(ahead).join(order.repartition("run"), ["run", "pos"])
    # shared rows are in suffix order by mid, partition number included; write them so that neighbours are in reach
    looked = in_order(looked.select("tid", "s", "depth", "name", "name1", "name2", F.col("mid").alias("place")), ["place"], "ordered", BY_PART_OF_KEY)
    drop_scratch(spark, shared, order)
    near = with_neighbours(looked, ["name", "name1", "name2"])

    def same(side: str):
        """How many of the first three phrases a neighbour shares."""
        one = F.col(f"{side}.name") == F.col("name")
        two = one & (F.col(f"{side}.name1") == F.col("name1")) & (F.col("name1") != 0)
        three = two & (F.col(f"{side}.name2") == F.col("name2")) & (F.col("name2") != 0)
        return F.coalesce(one.cast("int") + two.cast("int") + three.cast("int"), F.lit(0))

    alive = near.where((F.col("depth") > 0) & (F.greatest(same("prev"), same("next")) >= F.least("depth", F.lit(COMPARED)))).select("tid", "s")
    multiple = texts.where("copies > 1").select("tid", F.posexplode("depths").alias("s", "d")).where("d > 0").select("tid", "s")
    alive = alive.union(multiple).distinct()
    named = texts.select("tid", "key", "rep", F.least("copies", F.lit(2)).cast("int").alias("weight"))
    wanted = alive.groupBy("tid").agg(F.collect_list("s").alias("at")).join(named, "tid").select("key", "rep", "tid", "weight", "at")

    def stretches(raw: bytes, r) -> list[tuple]:
        t = Text(raw)
        k = np.flatnonzero(np.isin(t.index, np.asarray(r.at)))
        places = zip(t.at[k].tolist(), t.low[k].tolist(), t.high[k].tolist())
        return [(r.tid, r.weight, *_piece(raw, a, low, high, 0, WINDOW - 1)) for a, low, high in places]

    pieces = _with_texts(docs, wanted, "size(at)", stretches, _PIECE, "stretches")
    drop_scratch(spark, looked)
    spans, rest = _settled(pieces, "kinds")
    for width in WIDTHS:
        asked = rest.groupBy("tid").agg(F.collect_list(F.struct("at", "low", "high", "weight")).alias("parts"))
        asked = asked.join(named.drop("weight"), "tid").select("key", "rep", "tid", "parts")

        def blocks(raw: bytes, r, width=width) -> list[tuple]:
            """Pieces of the strings whose distance to their anchor has the same quotient by width."""
            out = []
            for x in r.parts:
                at, low, high = x["at"], x["low"], x["high"]
                for near in range((at - high) // width * width, at - low + 1, width):
                    far = near + width - 1
                    out.append((r.tid, x["weight"], *_piece(raw, at, max(low, at - far), min(high, at - near), near, far)))
            return out

        finer = _with_texts(docs, asked, "4 * size(parts)", blocks, _PIECE, "pieces")
        drop_scratch(spark, pieces)
        pieces = finer
        more, rest = _settled(pieces, "kinds")
        spans = spans.union(more)
    spans = spans.select("tid", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end"))
    spans = merge(spans.join(texts.where("copies = 1").select("tid"), "tid", "left_semi"))
    spans = spans.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cutting = spans.join(texts.select("tid", "key", "rep"), "tid").select("key", "rep", "spans")

    def remove(raw: bytes, r) -> list[tuple]:
        at, kept, gone = 0, hashlib.sha256(), 0
        for s in sorted(r.spans, key=lambda s: s["start"]):
            kept.update(raw[at : s["start"]])
            gone += s["end"] - s["start"]
            at = s["end"]
        kept.update(raw[at:])
        return [(r.key, gone, len(r.spans), kept.hexdigest())]

    partly = _with_texts(docs, cutting, "2 * size(spans)", remove, "key binary, n_removed long, n_spans long, kept string", "cut").dropDuplicates(["key"])
    wholly = texts.where("copies > 1").select("key", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept"))
    verdict = partly.union(wholly)
    return every.select("doc_id", "key", "n", "sha").join(verdict, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )


def _by(*columns: str):
    return Window.partitionBy(*columns[:-1]).orderBy(columns[-1])


def merge(spans: DataFrame) -> DataFrame:
    """Overlapping or touching (start, end) of a text made one."""
    by = Window.partitionBy("tid").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((reach.isNull() | (F.col("start") > reach)).cast("int")).over(by)
    return spans.withColumn("i", island).groupBy("tid", "i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of all `documents`: null and empty texts have no bytes and lose none, long ones count whole, equal
    rows lose all that is long enough, an empty table gives no rows, and other columns are not read."""
    return removed_spans(table(spark, sf_dir, "documents"))
