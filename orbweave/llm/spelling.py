"""Grouping of spelling variants by a dictionary of trie-node pairs.

Words are sorted and the nodes of their trie numbered; so are the nodes of the trie of reversed words. A word with a
position skipped is then two integers, the node of what stands before it and the node of what stands after; a whole word
is such a pair at each of its gaps. Equal pairs of two skipped words: one letter replaced. A skipped word's pair equal to
a whole word's: one letter inserted or deleted. Node numbers are exact, so nothing has to be compared again, and a pair
belongs to one whole word and to at most one skipped word for each letter of the alphabet: no group grows with the input.

Each trie is numbered in ranges of sorted words. A prefix that more than one range holds is a prefix of a splitter between
ranges; those nodes are numbered beforehand, all others by the one range that holds them.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import ascii_lower, cut, drop_scratch, partitions_for, table

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_TIMES = 7, 2
#: A form is so many times as frequent as its variant.
TIMES = 10
#: One of so many runs loses a letter.
LOSES = 31
#: Words of a range, and sampled words for each range from which splitters are taken; letters of a splitter.
RANGE_WORDS, SAMPLED, SPLITTER = 100_000, 20, 32
#: Low bits of a number that count inside a range.
COUNT_BITS = 40
WHOLE, SKIPPED, SKIPPED_FIRST = 0, 1, 2


def runs(docs: DataFrame) -> DataFrame:
    """word: the runs of letters of all texts with at least LEAST_LETTERS, A-Z lower-cased, one of LOSES losing a letter."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    found = found.where(F.length("run") >= LEAST_LETTERS)
    plain = F.octet_length("run") == F.length("run")
    found = found.select("id", F.when(plain, F.lower("run")).otherwise(ascii_lower(F.col("run"))).alias("run"))
    found = found.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return found.select(F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the distinct results of runs() that are long and frequent enough."""
    return runs(docs).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def splitters(words: DataFrame, by: Column, ranges: int, n: int) -> list[str]:
    """At most ranges - 1 strings that cut the words into ranges of about equal size."""
    every = max(1, n // (SAMPLED * ranges))
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select(F.substring(by, 1, SPLITTER).alias("w"))
    got = sorted(r["w"] for r in sample.collect())  # about SAMPLED for each range
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


class TrieNumbers:
    """Numbers of the prefixes of ascending words of one range after another."""

    def __init__(self, shared: dict[str, int]):
        self.shared, self.range, self.word, self.ids, self.next = shared, None, "", [], 0

    def of(self, word: str, part: int) -> list[int]:
        """The numbers of the prefixes of 0, 1, ... all letters."""
        if part != self.range:
            self.range, self.word, self.ids, self.next = part, "", [], part << COUNT_BITS
        same = 0
        for a, b in zip(word, self.word):
            if a != b:
                break
            same += 1
        ids = self.ids[: same + 1] if self.ids else []
        depth = len(ids)
        while depth <= len(word) and depth <= SPLITTER and (known := self.shared.get(word[:depth])) is not None:
            ids.append(known)
            depth += 1
        new = len(word) + 1 - depth
        ids.extend(range(self.next, self.next + new))
        self.next += new
        self.word, self.ids = word, ids
        return ids


def shared_nodes(cuts: list[str]) -> dict[str, int]:
    """Negative numbers of the prefixes of splitters, the root among them."""
    return {p: -1 - k for k, p in enumerate(sorted({s[:d] for s in ["", *cuts] for d in range(len(s) + 1)}))}


def in_ranges(words: DataFrame, by: Column, cuts: list[str], ranges: int) -> DataFrame:
    """words with __range and __by, each range in one partition in ascending order."""
    shared = words.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(w: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(shared.value, x) for x in w], dtype="int32")

    return words.withColumn("__by", by).withColumn("__range", range_of("__by")).repartition(ranges, "__range").sortWithinPartitions("__range", "__by")


def numbered_words(words: DataFrame, n: int) -> DataFrame:
    """wid (ascending with the words), word, n, pre: the forward node of each prefix. n: how many words there are."""
    ranges = partitions_for(words.sparkSession, n // RANGE_WORDS)
    cuts = splitters(words, F.col("word"), ranges, n)
    shared = shared_nodes(cuts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, part, at = TrieNumbers(shared), None, 0
        for pdf in frames:
            pre, wid = [], np.empty(len(pdf), np.int64)
            for k, (w, r) in enumerate(zip(pdf["word"], pdf["__range"].tolist())):
                part, at = (r, at + 1) if r == part else (r, 0)
                wid[k] = (r << COUNT_BITS) + at
                pre.append(trie.of(w, r))
            yield pd.DataFrame({"wid": wid, "word": pdf["word"], "n": pdf["n"], "pre": pre})

    return in_ranges(words, F.col("word"), cuts, ranges).select("word", "n", "__range").mapInPandas(run, "wid long, word string, n long, pre array<long>")


def node_pairs(words: DataFrame, n: int) -> DataFrame:
    """p, s, wid, n, kind for each gap and each skipped position of the numbered words: forward and backward node.

    kind: WHOLE, SKIPPED, or SKIPPED_FIRST where the letter before is another one (equal letters in a row leave the same
    word whichever is skipped, so only the first counts as a deletion).
    """
    ranges = partitions_for(words.sparkSession, n // RANGE_WORDS)
    cuts = splitters(words, F.reverse("word"), ranges, n)
    shared = shared_nodes(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieNumbers(shared)
        for batch in batches:
            p, s, kinds, times = [], [], [], []
            for w, r, pre in zip(batch.column("__by").to_pylist(), batch.column("__range").to_pylist(), batch.column("pre")):
                back = np.array(trie.of(w, r)[::-1], np.int64)  # back[i]: the suffix from i on
                pre = pre.values.to_numpy(zero_copy_only=False)
                signs = np.frombuffer(w[::-1].encode("utf-32-le"), np.uint32)
                first = np.ones(len(signs), bool)
                first[1:] = signs[1:] != signs[:-1]
                p += [pre, pre[:-1]]
                s += [back, back[1:]]
                kinds += [np.zeros(len(pre), np.int8), np.where(first, SKIPPED_FIRST, SKIPPED).astype(np.int8)]
                times.append(len(pre) + len(signs))
            if times:
                same = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in ("wid", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(p), np.concatenate(s), *same, np.concatenate(kinds))], ["p", "s", "wid", "n", "kind"])

    rows = in_ranges(words, F.reverse("word"), cuts, ranges).select("__by", "__range", "wid", "n", "pre")
    return rows.mapInArrow(run, "p long, s long, wid long, n long, kind byte")


def _links(p, s, wid, n, kind) -> tuple[np.ndarray, ...]:
    """wid, links, best n, best wid of the rows of whole groups, which are sorted by p, s, n descending and wid."""
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    group, wid, n, kind = np.unique(group[many], return_inverse=True)[1], wid[many], n[many], kind[many]
    groups, nobody = int(group.max()) + 1 if len(group) else 0, len(group)
    skipped, first = kind != WHOLE, kind == SKIPPED_FIRST
    at = np.arange(nobody)

    def top(mask: np.ndarray) -> np.ndarray:
        """The first row of each group inside mask; nobody if there is none."""
        out = np.full(groups, nobody)
        np.minimum.at(out, group[mask], at[mask])
        return out

    count = np.bincount(group[skipped], minlength=groups)
    count_first = np.bincount(group[first], minlength=groups)
    best = top(skipped)
    second = top(skipped & (at != best[group])) if nobody else best
    whole, best_first = top(~skipped), top(first)
    other = np.where(at == best[group], second[group], best[group])
    links = np.where(skipped, count[group] - 1 + (first & (whole[group] < nobody)), count_first[group])
    partner = np.where(skipped, np.where(first, np.minimum(other, whole[group]), other), best_first[group])
    has = links > 0
    return wid[has], links[has], n[partner[has]], wid[partner[has]]


def nearest(pairs: DataFrame) -> DataFrame:
    """wid, links, best_n, best_wid: for each pair of nodes and word that meets others there, how many are near and which
    of them is the most frequent (the smallest of equals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "s", "wid", "n", "kind")]
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            end = int(np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0])  # the last group may go on
            held = [x[end:] for x in now]
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _links(*[x[:end] for x in now])], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _links(*held)], names)

    names = ["wid", "links", "best_n", "best_wid"]
    dealt = pairs.repartition(F.col("p"), F.col("s")).sortWithinPartitions("p", "s", F.desc("n"), "wid")
    return dealt.mapInArrow(run, "wid long, links long, best_n long, best_wid long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """wid, form (a wid), root: the end of the chain of forms. most: the largest n; a step of a chain takes TIMES as much."""
    out = forms.withColumn("root", F.col("form"))
    steps = max(1, math.ceil(math.log(max(most, 2), TIMES)))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):  # each round doubles the reach
        out = cut(out, "roots")
        ahead = out.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        out = out.join(ahead, "root", "left").select("wid", "form", F.coalesce("further", "root").alias("root"))
    return out


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of counted_words().

    Null and empty texts have no runs, texts and runs of any length count whole, and each of repeated rows counts. A null
    doc_id stands as an empty string in the hash. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    words = cut(counted_words(docs), "words")
    size = words.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    known = cut(numbered_words(words, size["n"]), "numbered")
    near = nearest(node_pairs(known, size["n"])).groupBy("wid").agg(F.sum("links").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_wid")).alias("back"))).alias("best"))
    near = cut(near.select("wid", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.back")).alias("best_wid")), "near")
    plain = known.select("wid", "word", "n")
    rows = cut(plain.join(near, "wid", "left").withColumn("form", F.expr(f"CASE WHEN best_n >= {TIMES} * n THEN best_wid END")), "forms")
    linked = roots(rows.where("form IS NOT NULL").select("wid", "form"), size["most"] or 0)
    named = lambda c: plain.select(F.col("wid").alias(c), F.col("word").alias(f"{c}_word"))
    linked = linked.join(named("form"), "form").join(named("root"), "root").select("wid", "form_word", "root_word")
    out = rows.join(linked, "wid", "left").select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr("CASE WHEN form IS NOT NULL THEN best_n END").alias("form_n"),
    )
    out = cut(out, "spelling")
    drop_scratch(spark, words, known, near, rows)
    return out


def op12_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants and forms of the words of all `documents`: see spelling_groups() for nulls, empty and long texts, ties
    (smallest word), repeated rows, empty tables and other columns."""
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7),
x AS (SELECT doc_id, run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM (SELECT doc_id, run, count(*) AS times FROM r GROUP BY ALL)),
y AS (SELECT run, times, list_transform(range(length(hx) // 2), lambda k: CAST('0x' || substr(hx, 2 * k + 1, 2) AS BIGINT)) AS bytes FROM x),
h AS (SELECT run, times, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM y, crc_table),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
g AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) WHERE a.word <> b.word
          UNION SELECT g.word, v.word FROM g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word FROM g JOIN v ON g.rest = v.word),
near AS (SELECT a AS word, b, n AS bn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM pairs JOIN v ON v.word = b),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n
      FROM v LEFT JOIN near ON near.word = v.word AND k = 1),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""
