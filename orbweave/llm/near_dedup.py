"""Near-duplicates by MinHash bands and odd sketches, confirmed on full shingle sets.

Each document's set of word shingles (of SHINGLE words unless the caller says otherwise) gives K MinHash samples.
BANDS bands of ROWS samples make candidate buckets, and the samples are folded into an odd sketch: a bitmap of
parities, so that the number of ones in the XOR of two sketches tells how many samples differ. Equal sets are one node from the start. Nodes of a bucket are not paired
with all others: neighbours in random orders of each (salted) bucket meet, each node keeps its best partners by
sketch, the full sets confirm them, and components are joined; nodes that are not in their bucket's main component
then are compared with every node of another component there. A link is lost only where two sets share no band or
their sketches miss by far (chances beside BANDS and ESTIMATE_FLOOR).

Shingles are 64-bit hashes: that two of a pair's shingles are taken for one has a chance of about n squared in 2e19, n
being the shingles of both, 1e-10 for two texts of 20,000 words; it moves their similarity by one shingle.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import LOWER, UPPER, cut, drop_scratch, table
from orbweave.llm.components import components

SHINGLE = 4
PERCENT = 80
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**30 < 1e-5.
BANDS, ROWS = 30, 5
K = BANDS * ROWS
SKETCH_BITS = 512
#: Sketch estimates below this are not confirmed. A pair of similarity 0.8 falls there with a probability of about
#: 1e-8 (82 or fewer of 150 samples agree: 5e-11; the rest is the sketch's own error), far below what the bands miss.
ESTIMATE_FLOOR = 0.55
#: Random orders of the bucket members in which neighbours meet, and how many of its best partners a node keeps.
ORDERS, PARTNERS = 3, 2
#: Bucket members that meet in one sorted run of a round.
RUN = 200
#: Buckets up to this size are settled pair by pair, larger ones in blocks of up to BLOCK nodes that list no pairs.
SMALL = 32
BLOCK = 1_000
BATCH_DOCUMENTS = 500
#: Pairs of full sets handed to Python at once.
BATCH_PAIRS = 500
#: Document ids that may be broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans(UPPER, LOWER)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_seeded = np.random.Generator(np.random.PCG64(20_24))
_MULTIPLY = _seeded.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeded.integers(0, 2**63, K, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: dict[str, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; known caches word hashes."""
    words = _WORD.findall((text or "").translate(_FOLD))
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(a))
    if not n:
        return a
    with np.errstate(over="ignore"):
        h = np.full(len(a) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * _MIX + a[i : len(a) - n + 1 + i]
        return np.unique(_mixed(h))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(out, (_MULTIPLY[:, None] * shingles[None, at : at + 2048] + _ADD[:, None]).min(1), out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the number of samples that fall on each bit."""
    with np.errstate(over="ignore"):
        at = _mixed(samples + np.arange(1, K + 1, dtype=np.uint64) * _MIX) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8))


def estimated_similarity(ones: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the ones in the XOR of two odd sketches."""
    return 1 + SKETCH_BITS / (4 * K) * np.log(np.maximum(1 - 2 * ones / SKETCH_BITS, 1e-9))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key (MD5 of the text), n_shingles, key (128-bit hash of the set, null when empty), bands and odd sketch of each row."""

    def run(frames):
        known: dict[str, int] = {}
        for pdf in frames:
            if len(known) > 300_000:
                known.clear()
            rows = []
            for text in pdf["text"]:
                s = shingle_set(text, known, size)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                m = min_hashes(s)
                bands = [xxhash.xxh3_64_intdigest(m[ROWS * b : ROWS * b + ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]
                rows.append((len(s), _key(s), bands, odd_sketch(m).tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "key", "bands", "odd"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "text_key", pdf["text_key"].to_numpy())
            yield out

    read = docs.select("doc_id", F.md5("text").alias("text_key"), "text")
    schema = read.select("doc_id", "text_key", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("array<long>").alias("bands"), F.lit(None).cast("binary").alias("odd")).schema
    return read.mapInPandas(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """key and shingles (bytes) of each wanted (key, doc_id), from the texts."""
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(frames):
        known: dict[str, int] = {}
        for pdf in frames:
            if len(known) > 300_000:
                known.clear()
            sets = [shingle_set(t, known, size) for t in pdf["text"]]
            yield pd.DataFrame({"key": [_key(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    some = docs.select("doc_id", "text").where("text is not null").join(ids, F.expr("doc_id <=> wanted_id"), "left_semi")
    return some.mapInPandas(run, "key binary, shingles binary").join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def _estimated(pairs: DataFrame, odd: DataFrame) -> DataFrame:
    """pairs (a, b) with est, those under the floor left out."""

    def run(frames):
        for pdf in frames:
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("x", "y"))
            est = estimated_similarity(np.unpackbits(x ^ y, axis=1).sum(1)) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "est": est})[est >= ESTIMATE_FLOOR]

    a, b = odd.toDF("a", "x"), odd.toDF("b", "y")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInPandas(run, "a binary, b binary, est double")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with ok: whether the full sets are similar enough."""

    def run(frames):
        for pdf in frames:
            sizes = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["x"], pdf["y"])]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "ok": np.array(sizes, bool)})

    a, b = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInPandas(run, "a binary, b binary, ok boolean")


def _links_in_blocks(split: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of nodes outside their bucket's main component to nodes of other components.

    split: band, n, key, root, main. Bucket members are dealt into blocks; each pair of blocks is one small task, which
    compares full sets and returns the links that join components which it has not seen joined before.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = split.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    asking = rows.where("root <> main")
    asks = asking.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    asks = asks.select("band", F.col("block").alias("i"), F.col("other").alias("j"), "key", "root", F.lit(True).alias("asks"))
    # members go only to blocks in which somebody asks
    heard = cut(asking.select("band", F.col("block").alias("i")).distinct(), "asking")
    told = rows.join(heard, "band").select("band", "i", F.col("block").alias("j"), "key", "root", F.lit(False).alias("asks"))
    dealt = asks.union(told).join(sets, "key")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, joined = [], {}

        def find(x):
            while x in joined:
                x = joined[x]
            return x

        told = pdf[~pdf["asks"]]
        asking = pdf[pdf["asks"]]
        if len(told) and len(asking):
            flat = np.concatenate([np.frombuffer(x, np.uint64) for x in told["shingles"]])
            vocabulary, coded = np.unique(flat, return_inverse=True)
            sizes = np.array([len(x) // 8 for x in told["shingles"]])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            keys, roots = told["key"].to_numpy(), told["root"].to_numpy()
            for key, root, body in zip(asking["key"], asking["root"], asking["shingles"]):
                own = np.frombuffer(body, np.uint64)
                at = np.searchsorted(vocabulary, own)
                at = at[at < len(vocabulary)]
                mark = np.zeros(len(vocabulary), np.int64)
                mark[at[np.isin(vocabulary[at], own)]] = 1
                both = np.add.reduceat(mark[coded], starts)
                near = np.flatnonzero(100 * both >= PERCENT * (sizes + len(own) - both))
                for k in near:  # a spanning forest is enough: only links that join what this task has not joined yet
                    x, y = find(root), find(roots[k])
                    if x != y:
                        joined[x] = y
                        out.append((min(key, keys[k]), max(key, keys[k])))
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.groupBy("band", "i", "j").applyInPandas(run, "a binary, b binary").distinct()


def _placed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, root (null for sets without words), n_shingles, component_id and kept for each row of docs."""
    spark = docs.sparkSession
    sketched = cut(sketches(docs, size), "sketches", BATCH_DOCUMENTS)
    # equal sets are one row before anything is dealt by their key
    each = sketched.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("odd").alias("odd")
    )
    each = cut(each, "sets")
    members = each.select(F.explode("bands").alias("band"), "key").distinct()
    crowded = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(members.join(crowded, "band"), "bands")
    first = cut(each.join(members.select("key").distinct(), "key", "left_semi").select("key", "doc_id", "odd"), "nodes")
    odd = first.select("key", "odd")
    sets = cut(_sets(docs, first.select("key", "doc_id"), size), "sets", BATCH_DOCUMENTS)
    roots = first.select(F.col("key").alias("node"), F.col("key").alias("root"))
    tested = None

    def settle(pairs: DataFrame) -> DataFrame:
        nonlocal tested
        new = _confirmed(pairs, sets)
        tested = cut(new if tested is None else tested.union(new), "tested", BATCH_PAIRS)
        found = components(tested.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v")))
        return cut(first.select(F.col("key").alias("node")).join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")

    pairs = None
    for r in range(ORDERS):
        seeded = F.xxhash64(F.lit(r), "key")
        run = Window.partitionBy("band", F.pmod(F.xxhash64(F.lit(-1 - r), "key"), F.ceil(F.col("n") / RUN))).orderBy(seeded, "key")
        met = members.select("key", F.lag("key").over(run).alias("p")).where("p IS NOT NULL")
        met = met.select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b"))
        pairs = met if pairs is None else pairs.union(met)
    scored = cut(_estimated(pairs.distinct(), odd), "pairs", 20 * BATCH_PAIRS)
    both = scored.select("a", "b", "est").union(scored.select("b", "a", "est"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("est"), "b"))
    chosen = both.withColumn("place", place).where(F.col("place") <= PARTNERS)
    roots = settle(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    placed = cut(members.join(roots, F.col("key") == F.col("node")).select("band", "n", "key", "root"), "placed")
    parts = placed.groupBy("band", "root").agg(F.count("*").alias("m"))
    main = parts.groupBy("band").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    split = cut(placed.join(main.select("band", "main"), "band"), "split")
    found = cut(_links_in_blocks(split.where(F.col("n") > SMALL), sets), "block-links")
    tested = cut(tested.union(found.select("a", "b", F.lit(True))), "tested")
    small = split.where(F.col("n") <= SMALL)
    rest = small.where("root <> main").select("band", F.col("key").alias("k"), F.col("root").alias("r"))
    pairs = (
        rest.join(small, "band")  # at most SMALL rows for each row
        .where((F.col("r") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("k") < F.col("key"))))
        .select(F.least("k", "key").alias("a"), F.greatest("k", "key").alias("b"))
        .distinct()
    )
    roots = settle(_estimated(untested(pairs), odd))
    owned = each.select("key", "doc_id", "copies").join(roots, F.col("key") == F.col("node"), "left")
    owned = cut(owned.select("key", "doc_id", "copies", F.coalesce("root", "key").alias("root")), "owned")
    names = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("size")).where("size > 1").drop("size")
    # tables, so that the joins can split the rows of a large component or a very frequent set
    named = cut(owned.select("key", "root").join(cut(names, "names"), "root", "left"), "components")
    drop_scratch(spark, members, first, sets, scored, placed, split, found, tested)
    out = sketched.select("doc_id", "text_key", "n_shingles", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "text_key", "root", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs, by shingles of size words.

    Sets without words link with nothing: their component is themselves. Rows with equal sets are linked whatever
    their ids; null ids never become a component's id unless the component has no other, and such a row counts as kept.
    """
    return _placed(docs, size).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs with exactly one row of each group of near-duplicates: of the smallest id; where rows share it, that of the
    smallest hash of the text, and of equal texts the smallest row. Rows without words are no group and stay."""
    placed = cut(_placed(docs, size), "placed-rows")
    texts = placed.where("kept and root is not null").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    one = texts.groupBy("root").agg(F.min(F.struct("text_key", "doc_id", "n")).alias("m")).select("m.*")
    wordless = placed.where("root is null").select("text_key", "doc_id", F.lit(1).cast("long").alias("n")).distinct()
    chosen = cut(one.union(wordless).select("text_key", "doc_id", "n"), "chosen")
    drop_scratch(docs.sparkSession, placed)
    # the row travels as one struct, so that none of its columns can clash with ours
    rows = docs.select(F.md5("text").alias("text_key"), F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col("text_key").alias("own_key"), F.col("doc_id").alias("own_id"))
        return rows.join(wanted, F.expr("doc_id <=> own_id AND text_key <=> own_key"), "left_semi")

    repeated = of(chosen.where("n > 1")).groupBy("doc_id", "text_key").agg(F.min("row").alias("row")).select("row")
    return of(chosen.where("n = 1")).select("row").union(repeated).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` by four-word shingles: see near_duplicates for nulls, empty texts, repeated ids and ties.

    Long texts take part whole; other columns are not read; an empty table gives no rows.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), 4)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN n u ON u.r = x JOIN n v ON v.r = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
t(x, y) AS (SELECT x, y FROM l UNION SELECT t.x, l.y FROM t JOIN l ON t.y = l.x),
c AS (SELECT x, min(doc_id) AS m FROM t JOIN d ON d.r = t.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c ON c.x = d.r
"""
