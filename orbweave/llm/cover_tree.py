"""Exact cosine links by dual traversal of a cover tree.

Vectors are put on the unit sphere, where cosine 0.9 is a distance of sqrt(0.2). The upper levels of the tree are
Spark tables: vectors fall to the nearest pivot of a bounded sample (a cell), cells make blocks of bounded size. The
lower levels, with halving radii, are built inside each block. Pairs of nodes are followed down only while the
distance of their centres is at most the sum of their covering radii and the threshold, both between blocks (which
pairs meet at all) and inside a pair of blocks. What is left is compared in double precision.

Nodes so close that all their points are linked are counted as a whole, by multiplicity, and joined by one edge. A block
pair returns, for each vector with links, how many and one edge to its local component; no pair of points outlives the
slab of products in which it was found. Equal vectors are one point with a multiplicity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import cut, table
from orbweave.llm.components import components

#: Pivots of the upper level, from a sample by hash; the driver holds no more vectors than these.
MAX_PIVOTS = 1_024
POINTS_PER_PIVOT = 200
BLOCK_POINTS = 3_000
#: Vectors handed to Python at once.
BATCH_VECTORS = 1_000
#: Radii of the levels inside a block, each half of that before.
RADII = (0.5, 0.25, 0.125)
SLACK = 1e-9
#: Nodes are compared in single precision with this much room; points in double precision without.
ROUGH = 1e-5
#: What a pair of nodes must fall short of the threshold by for all its points to count as linked.
INSIDE = 1e-6
#: Products that a worker holds at once.
SLAB_CELLS = 1_000_000


def unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    return matrix / np.sqrt((matrix * matrix).sum(1))[:, None]


def cover(points: np.ndarray, radius: float) -> np.ndarray:
    """Greedy net: for each point the number of its node, nodes being points over radius apart from earlier ones."""
    node, centres = np.full(len(points), -1), 0
    close = 1 - radius * radius / 2
    for i in range(len(points)):
        if node[i] < 0:
            node[(points @ points[i] >= close) & (node < 0)] = centres
            node[i] = centres
            centres += 1
    return node


def levels_of(points: np.ndarray) -> np.ndarray:
    """Node number of each point on each level of RADII, nested: a row for each level."""
    labels = [np.zeros(len(points), np.int32)]
    for radius in RADII:
        finer, at = np.empty(len(points), np.int32), 0
        order = np.argsort(labels[-1], kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(labels[-1][order])) + 1):
            node = cover(points[own], radius) if len(own) > 1 else np.zeros(1, np.int32)
            finer[own] = node + at
            at += node.max() + 1
        labels.append(finer)
    return np.array(labels[1:], np.int32)


class Level:
    """Nodes of one level: centre (a member), covering radius, the points [start, end) of each, and the nodes [low, high)
    of each node of the level above."""

    def __init__(self, points: np.ndarray, parents: np.ndarray, nodes: np.ndarray):
        count = int(nodes[-1]) + 1
        self.start, self.end = (np.searchsorted(nodes, np.arange(count), side) for side in ("left", "right"))
        self.size = self.end - self.start
        self.centre = self.start
        away = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", points, points[self.centre[nodes]]), 0))
        self.radius = np.maximum.reduceat(away, self.start)
        above = parents[self.start]
        self.low, self.high = (np.searchsorted(above, np.arange(int(above[-1]) + 1), side) for side in ("left", "right"))


class Tree:
    """Levels of a block, the last one being points."""

    def __init__(self, points: np.ndarray, levels: np.ndarray):
        labels = [np.zeros(len(points), np.int64), *levels.astype(np.int64)]
        #: Points in tree order, so that numbers grow alike on every level; place[k] is the given number of point k.
        self.place = np.argsort(labels[-1], kind="stable")
        self.points = points[self.place]
        self.rough = self.points.astype(np.float32)
        ordered = [x[self.place] for x in labels] + [np.arange(len(points))]
        self.levels = [Level(self.points, upper, lower) for upper, lower in zip(ordered, ordered[1:])]


def _expanded(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each two ranges."""
    width = high_b - low_b
    size = (high_a - low_a) * width
    which = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return low_a[which] + at // width[which], low_b[which] + at % width[which]


class Links:
    """Number of links of each point and connected components, gathered without keeping any pair.

    Points of the second tree come after those of the first; for a tree with itself they are the same points.
    """

    def __init__(self, a: Tree, b: Tree, cosine: float, same: bool, copies_a: np.ndarray, copies_b: np.ndarray):
        self.a, self.b, self.cosine, self.same = a, b, cosine, same
        self.shift = 0 if same else len(a.points)
        self.copies = (copies_a[a.place] if same else np.concatenate((copies_a[a.place], copies_b[b.place]))).astype(np.float64)
        self.before = np.concatenate(([0], np.cumsum(self.copies)))
        self.count = np.zeros(len(self.copies))
        self.root = np.arange(len(self.copies))

    def _join(self, u: np.ndarray, v: np.ndarray) -> None:
        u, v = self.root[u], self.root[v]
        apart = u != v
        if apart.any():
            pair = np.unique(np.minimum(u, v)[apart] * len(self.root) + np.maximum(u, v)[apart])
            self.root = _local_roots(len(self.root), pair // len(self.root), pair % len(self.root))[self.root]

    def points(self, i: np.ndarray, j: np.ndarray) -> None:
        """Linked points; of one tree, each pair once and none with itself."""
        j = j + self.shift
        self.count += np.bincount(i, self.copies[j], len(self.count)) + np.bincount(j, self.copies[i], len(self.count))
        self._join(i, j)

    def nodes(self, x: Level, p: np.ndarray, y: Level, q: np.ndarray) -> None:
        """Nodes all of whose points are linked; of one tree, a node with itself too."""
        ranges = []
        for start, end, other_start, other_end in ((x.start[p], x.end[p], y.start[q] + self.shift, y.end[q] + self.shift), (y.start[q] + self.shift, y.end[q] + self.shift, x.start[p], x.end[p])):
            ranges.append((start, end, self.before[other_end] - self.before[other_start]))
        own = (p == q) if self.same else np.zeros(len(p), bool)
        steps = np.zeros(len(self.count) + 1)
        for k, (start, end, weight) in enumerate(ranges):
            weight = np.where(own, 0 if k else weight, weight)  # a node with itself counts once
            np.add.at(steps, start, weight)
            np.add.at(steps, end, -weight)
        self.count += np.cumsum(steps)[:-1]
        inner = np.zeros(len(self.count) + 1)
        np.add.at(inner, x.start[p[own]], 1.0)
        np.add.at(inner, x.end[p[own]], -1.0)
        self.count -= np.cumsum(inner)[:-1] * self.copies  # no point links with itself
        joined = np.zeros(len(self.count) + 1, np.int64)  # 1 where a point is with the one before it
        for start, end, _ in ranges:
            np.add.at(joined, np.minimum(start + 1, end), 1)
            np.add.at(joined, end, -1)
        inside = np.flatnonzero(np.cumsum(joined)[:-1] > 0)
        self._join(inside, inside - 1)
        self._join(x.start[p], y.start[q] + self.shift)


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Double-precision products of rows, a bounded number of copied rows at a time."""
    out, rows = np.empty(len(i)), max(1, SLAB_CELLS * 4 // max(1, x.shape[1]))
    for at in range(0, len(i), rows):
        out[at : at + rows] = np.einsum("ij,ij->i", x[i[at : at + rows]], y[j[at : at + rows]])
    return out


def links_between(a: Tree, b: Tree, cosine: float, same: bool, copies_a: np.ndarray, copies_b: np.ndarray) -> Links:
    """Links between two trees (of one tree: with itself).

    Node pairs are followed down while they may hold a link. A pair whose points are linked whatever they are, by distance
    and radii, is counted at once; so are pairs of single points. What is carried are arrays of node pairs; products are
    taken in slabs of SLAB_CELLS, so memory does not grow with the links.
    """
    found = Links(a, b, cosine, same, copies_a, copies_b)
    edge = float(np.sqrt(2 - 2 * cosine))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for x, y in zip(a.levels, b.levels):
        carried: list[tuple[np.ndarray, np.ndarray]] = []

        def settle(p: np.ndarray, q: np.ndarray, rough: np.ndarray | None = None, x=x, y=y, carried=carried) -> None:
            if same:
                keep = p <= q
                p, q, rough = p[keep], q[keep], rough[keep] if rough is not None else None
            single = (x.size[p] == 1) & (y.size[q] == 1)
            if same:
                p, q, rough, single = (v[~single | (p != q)] if v is not None else None for v in (p, q, rough, single))
            u, v = p[single], q[single]
            linked = rough[single] >= cosine + ROUGH if rough is not None else np.zeros(len(u), bool)
            open_ = np.flatnonzero(~linked)
            linked[open_] = _dots(a.points, x.centre[u[open_]], b.points, y.centre[v[open_]]) >= cosine
            found.points(x.centre[u[linked]], y.centre[v[linked]])
            p, q = p[~single], q[~single]
            if len(p):
                far = np.sqrt(np.maximum(2 - 2 * _dots(a.points, x.centre[p], b.points, y.centre[q]), 0))
                room = x.radius[p] + y.radius[q]
                sure = far + room <= edge - INSIDE
                if sure.any():
                    found.nodes(x, p[sure], y, q[sure])
                left = ~sure & (far <= room + edge + SLACK)
                carried.append((p[left], q[left]))

        size = (x.high[i] - x.low[i]) * (y.high[j] - y.low[j])
        small, large = np.flatnonzero(size <= 64), np.flatnonzero(size > 64)
        for at in range(0, len(small), SLAB_CELLS // 64):
            k = small[at : at + SLAB_CELLS // 64]
            settle(*_expanded(x.low[i[k]], x.high[i[k]], y.low[j[k]], y.high[j[k]]))
        for k in large:
            lo, hi = y.low[j[k]], y.high[j[k]]
            rows = max(1, SLAB_CELLS // (hi - lo))
            for first in range(x.low[i[k]], x.high[i[k]], rows):
                last = min(first + rows, x.high[i[k]])
                rough = a.rough[x.centre[first:last]] @ b.rough[y.centre[lo:hi]].T
                far = (x.radius[first:last, None] + y.radius[None, lo:hi] + edge + SLACK).astype(np.float32)
                p, q = np.nonzero(rough >= 1 - far * far / 2 - ROUGH)
                settle(p + first, q + lo, rough[p, q])
        i, j = (np.concatenate(v) if carried else np.empty(0, np.int64) for v in (zip(*carried) if carried else ((), ())))
        if not len(i):
            break
    return found


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _usable(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, dims, bodies = [], [], []
    for v in pdf["embedding"]:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
        ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
        body = x.tobytes() if ok else None
        keys.append(xxhash.xxh3_128_digest(body) if ok else None)
        dims.append(len(x) if ok else 0)
        bodies.append(body)
    return pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "key": keys, "dim": dims, "body": bodies})


def cosine_links(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of
    different lengths do not link. Equal vectors of different rows are linked. Null ids never name a component that
    has another id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInPandas(lambda it: map(_usable, it), "vec_id long, key binary, dim int, body binary")
    rows = cut(rows, "vectors", BATCH_VECTORS)
    points = rows.where("key is not null").groupBy("key", "dim").agg(F.any_value("body").alias("body"), F.count("*").alias("copies"))
    points = cut(points, "points")
    per_dim = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots: dict[int, list[bytes]] = {}
    for dim, n in per_dim.items():
        share = min(1.0, max(1.0, min(MAX_PIVOTS, n / POINTS_PER_PIVOT)) / n)
        at = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= int(share * (1 << 30))
        found = points.where((F.col("dim") == dim) & at).select("key", "body").orderBy("key").limit(MAX_PIVOTS).collect()
        pivots[dim] = [r["body"] for r in found] or [points.where(F.col("dim") == dim).select(F.min("body")).first()[0]]
    shared = spark.sparkContext.broadcast(pivots)

    def assign(frames):
        for pdf in frames:
            cell = np.zeros(len(pdf), np.int64)
            for dim, own in pdf.groupby("dim"):
                x = unit(np.frombuffer(b"".join(own["body"]), np.float64).reshape(len(own), -1))
                p = unit(np.frombuffer(b"".join(shared.value[dim]), np.float64).reshape(-1, dim))
                cell[pdf.index.get_indexer(own.index)] = (x @ p.T).argmax(1)
            pdf["cell"] = cell
            yield pdf

    placed = cut(points.mapInPandas(assign, "key binary, dim int, body binary, copies long, cell long"), "cells", BATCH_VECTORS)
    blocks, plan, held, last = 0, [], 0, None
    for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).orderBy("dim", "cell").collect():  # MAX_PIVOTS a dim
        parts = -(-r["n"] // BLOCK_POINTS)
        if parts > 1 or r["dim"] != last or held + r["n"] > BLOCK_POINTS:
            blocks += 1 if plan else 0
            held = 0
        plan.append((r["dim"], r["cell"], blocks, parts))
        held += r["n"] if parts == 1 else BLOCK_POINTS
        blocks += parts - 1
        last = r["dim"]
    if not plan:
        placed_blocks = None
    else:
        plan = F.broadcast(spark.createDataFrame(plan, "dim int, cell long, base int, parts int"))
        block = F.col("base") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
        placed_blocks = placed.join(plan, ["dim", "cell"]).select(block.alias("block"), F.col("base").alias("unit"), "dim", "key", "body", "copies")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.frombuffer(b"".join(pdf["body"]), np.float64).reshape(len(pdf), -1))
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        return pd.DataFrame(
            {
                "block": pdf["block"][:1], "unit": pdf["unit"][:1], "dim": pdf["dim"][:1], "keys": [b"".join(pdf["key"])], "body": [b"".join(pdf["body"])],
                "levels": [levels_of(x).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "centre": [centre.tolist()], "radius": [radius],
            }
        )

    def meet(frames):
        trees: dict[int, Tree] = {}

        def tree(block, dim, body, levels):
            if block not in trees:
                if len(trees) >= 4:
                    trees.pop(next(iter(trees)))
                points = unit(np.frombuffer(body, np.float64).reshape(-1, dim))
                trees[block] = Tree(points, np.frombuffer(levels, np.int32).reshape(len(RADII), -1))
            return trees[block]

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                same = r.i == r.j
                a = tree(r.i, r.dim, r.body_i, r.levels_i)
                b = a if same else tree(r.j, r.dim, r.body_j, r.levels_j)
                found = links_between(a, b, cosine, same, np.frombuffer(r.copies_i, np.int64), np.frombuffer(r.copies_j, np.int64))
                order = a.place if same else np.concatenate((a.place, b.place + len(a.points)))  # of the keys, in tree order
                keys = np.frombuffer(r.keys_i if same else r.keys_i + r.keys_j, "S1").reshape(-1, 16)[order]
                some = np.flatnonzero(found.count)
                yield pd.DataFrame(
                    {"key": [keys[k].tobytes() for k in some], "links": np.rint(found.count[some]).astype(np.int64), "other": [keys[found.root[k]].tobytes() for k in some]}
                )

    if placed_blocks is not None:
        packed = placed_blocks.groupBy("block", "dim").applyInPandas(
            pack, "block int, unit int, dim int, keys binary, body binary, levels binary, copies binary, centre array<double>, radius double"
        )
        packed = cut(packed, "blocks")
        outline = packed.select("block", "unit", "dim", "centre", "radius")
        edge = float(np.sqrt(2 - 2 * cosine)) + SLACK
        apart = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda c, d: (c - d) * (c - d)), F.lit(0.0), lambda sum_, c: sum_ + c))
        # the blocks of a cell make a unit, or the cells of a block: MAX_PIVOTS a dim at most, so these pairs are bounded
        middle = outline.groupBy("dim", "unit").agg(F.min_by("centre", "block").alias("middle"))
        units = outline.join(middle, ["dim", "unit"]).groupBy("dim", "unit").agg(F.first("middle").alias("middle"), F.max(apart("middle", "centre") + F.col("radius")).alias("reach"))
        other = units.select("dim", *[F.col(c).alias(f"{c}_j") for c in ("unit", "middle", "reach")])
        near = units.join(other, "dim").where((F.col("unit") <= F.col("unit_j")) & (apart("middle", "middle_j") <= F.col("reach") + F.col("reach_j") + edge)).select("unit", "unit_j")
        far = outline.select(*[F.col(c).alias(f"{c}_j") for c in outline.columns])
        pairs = (
            near.join(outline, "unit")
            .join(far, "unit_j")
            .where((F.col("block") <= F.col("block_j")) & (apart("centre", "centre_j") <= F.col("radius") + F.col("radius_j") + edge))
            .select(F.col("block").alias("i"), F.col("block_j").alias("j"))
        )
        bodies = packed.select("block", "dim", "keys", "body", "levels", "copies")
        first = bodies.toDF("i", "dim", "keys_i", "body_i", "levels_i", "copies_i")
        second = bodies.drop("dim").toDF("j", "keys_j", "body_j", "levels_j", "copies_j")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks)
        dealt = pairs.repartition(parts, "i", "j").join(first, "i").join(second, "j")
        found = dealt.select("i", "j", "dim", "keys_i", "body_i", "levels_i", "copies_i", "keys_j", "body_j", "levels_j", "copies_j").mapInPandas(
            meet, "key binary, links long, other binary"
        )
        found = cut(found, "links", 8)
    else:
        found = spark.createDataFrame([], "key binary, links long, other binary")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("u"), F.col("other").alias("v")))
    summary = (
        points.select("key", "copies")
        .join(counts, "key", "left")
        .join(roots, F.col("key") == F.col("node"), "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
        .where("n_links > 0")
    )
    ids = rows.select("vec_id", "key").join(summary, "key", "left")
    names = ids.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    ids = ids.select("vec_id", "n_links", F.col("root").alias("own")).join(names, F.col("own") == F.col("root"), "left")
    component = F.coalesce("component_id", "vec_id")
    return ids.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )


def op3_cover_tree_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all `embeddings`: see cosine_links for nulls, repeats and empty tables; other columns are not read."""
    return cosine_links(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
t(x, y) AS (SELECT x, y FROM l UNION SELECT t.x, l.y FROM t JOIN l ON t.y = l.x),
c AS (SELECT x, min(y) AS m FROM t GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""
