"""Quality classification by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (lengths, character classes, repetition). Class means and
covariances come from sums that Spark adds up over all labelled training rows; covariances are shrunk towards the
pooled one and its diagonal. A text's score is the difference of the two log densities, with Mahalanobis distances
from Cholesky factors that are made once, mapped to 0..1 by a logistic curve fitted on training rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import cut, drop_scratch, table

#: Shares of the pooled covariance, and of its diagonal, in a class covariance.
POOLED, DIAGONAL = 0.1, 0.1
THRESHOLD = 0.3
BATCH_DOCUMENTS = 500
#: Ids of labelled rows that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Width of the bins of log-density differences from which the logistic curve is fitted, and their range.
BIN, RANGE = 0.5, 60.0

_KIND = np.zeros(256, np.int8)  # 0 other symbols, then the classes below
for _c in range(256):
    _KIND[_c] = (
        1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c == 10 else 5 if _c in (9, 13, 32) else 6 if _c >= 128 else 7 if _c in b".,;:?'\"()-" else 0
    )
FEATURES = 20


def text_statistics(text: str | None) -> list[float]:
    """FEATURES transformed statistics; a null text counts as empty, and an empty one has defined values too."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    by = np.bincount(_KIND[raw], minlength=8) if n else np.zeros(8)
    words = text.split()
    m = len(words)
    times = Counter(words)
    top = times.most_common(1)[0][1] if m else 0
    lines = text.split("\n")
    letters = max(1, by[1] + by[2] + by[6])
    short = sum(c for w, c in times.items() if len(w) <= 3)
    shout = sum(c for w, c in times.items() if w.isupper() and len(w) > 1)
    lone = sum(c for w, c in times.items() if not any(x.isalnum() for x in w[:3]))
    stops = sum(c for w, c in times.items() if w[-1] in ".!?")
    starts = sum(c for w, c in times.items() if w[0].isupper())
    tails = sum(c for w, c in times.items() if len(w) > 2 and not w[-2].isalnum())
    same = sum(a == b for a, b in zip(words, words[1:]))
    share = lambda a, b: float(a) / max(1.0, float(b))
    root = lambda a, b: share(a, b) ** 0.5
    return [
        np.log1p(n),
        np.log1p(m),
        share(n, m) if m else 0.0,
        root(by[2], letters),
        root(by[3], n),
        root(by[0], n),
        root(by[7], n),
        root(by[6], n),
        root(by[4], n),
        root(top, m),
        np.log1p(len(times)) - np.log1p(m),
        root(same, m),
        share(short, m),
        root(shout, m),
        root(lone, m),
        root(stops, m),
        root(starts, m),
        root(tails, m),
        np.log1p(share(m, len(lines))),
        root(len(lines) - len(set(lines)), len(lines)),
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns of docs and `__stats`, one row for each row."""
    column = "text" if "text" in keep else "__text"

    def run(frames):
        for pdf in frames:
            text = pdf[column] if column == "text" else pdf.pop(column)
            pdf["__stats"] = [text_statistics(t) for t in text]
            yield pdf

    kept = docs.select(*keep) if column == "text" else docs.select(*keep, F.col("text").alias(column))
    schema = kept.drop("__text").withColumn("__stats", F.array().cast("array<double>")).schema
    return kept.mapInPandas(run, schema)


class QuadraticDiscriminant:
    """Two Gaussian classes, kept as means and inverse Cholesky factors."""

    def __init__(self, counts: dict[int, int], sums: dict[int, np.ndarray], products: dict[int, np.ndarray]):
        d = len(next(iter(sums.values()))) if sums else FEATURES
        total = max(1, sum(counts.values()))
        scatter = {k: products[k] - np.outer(sums[k], sums[k]) / counts[k] for k in counts}
        pooled = sum(scatter.values(), np.zeros((d, d))) / total + 1e-6 * np.eye(d)
        target = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled))
        self.means, self.factors, self.constants = {}, {}, {}
        for k in (0, 1):
            n = counts.get(k, 0)
            own = scatter[k] / n if n else pooled
            share = max(POOLED, min(1.0, d / (n + 1)))
            cov = (1 - share) * own + share * target
            low = np.linalg.cholesky(cov)
            self.means[k] = sums[k] / n if n else np.zeros(d)
            self.factors[k] = np.linalg.inv(low).T
            self.constants[k] = np.log((n + 1) / (total + 2)) - np.log(np.diag(low)).sum()
        self.slope, self.offset = 1.0, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, priors included."""
        part = [self.constants[k] - 0.5 * (((x - self.means[k]) @ self.factors[k]) ** 2).sum(1) for k in (0, 1)]
        return part[1] - part[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + self.slope * np.clip(self.difference(x), -RANGE, RANGE))))


def _moments(labelled: DataFrame) -> QuadraticDiscriminant:
    """labelled: y (0 or 1) and __stats. Sums per batch, added up by Spark; the driver gets two small matrices."""

    def run(frames):
        for pdf in frames:
            for y, own in pdf.groupby("y"):
                x = np.vstack(own["__stats"].to_numpy())
                cells = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
                yield pd.DataFrame({"y": int(y), "cell": np.arange(len(cells)), "v": cells})

    rows = labelled.mapInPandas(run, "y int, cell int, v double").groupBy("y", "cell").agg(F.sum("v").alias("v")).collect()
    got = {y: np.zeros(1 + FEATURES + FEATURES**2) for y in {r["y"] for r in rows}}
    for r in rows:
        got[r["y"]][r["cell"]] = r["v"]
    cut_at = 1 + FEATURES
    return QuadraticDiscriminant(
        {y: int(v[0]) for y, v in got.items()}, {y: v[1:cut_at] for y, v in got.items()}, {y: v[cut_at:].reshape(FEATURES, FEATURES) for y, v in got.items()}
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Coefficients of a slightly ridged logistic regression on weighted rows: Newton steps, halved until they help."""
    scale = np.maximum(np.abs(x).max(0), 1e-12)
    z, ridge = x / scale, 1e-4 * max(1.0, weight.sum())

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float(weight @ (np.logaddexp(0, t) - y * t) + 0.5 * ridge * (w @ w) * 1e-2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (weight * (p - y)) + ridge * 1e-2 * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * 1e-2 * np.eye(len(w))
        step, t = -np.linalg.solve(bend, slope), 1.0
        while t > 1e-8 and loss(w + t * step) > now + 1e-4 * t * (slope @ step):
            t /= 2
        w, before = w + t * step, now
        now = loss(w)
        if before - now <= 1e-9 * (1 + abs(before)):
            break
    return w / scale


def _apply(stats: DataFrame, model: QuadraticDiscriminant, column: str, what: str) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)  # 2 x FEATURES x FEATURES numbers

    def run(frames):
        for pdf in frames:
            x = np.vstack(pdf.pop("__stats").to_numpy()) if len(pdf) else np.zeros((0, FEATURES))
            pdf[column] = getattr(shared.value, what)(x)
            yield pdf

    return stats.mapInPandas(run, stats.drop("__stats").withColumn(column, F.lit(0.0)).schema)


def fit(labelled: DataFrame) -> QuadraticDiscriminant:
    """Model of y (0 or 1) given __stats. With one class or no rows it still gives defined scores."""
    model = _moments(labelled)
    bins = (
        _apply(labelled, model, "d", "difference")
        .groupBy("y", F.round(F.greatest(F.least("d", F.lit(RANGE)), F.lit(-RANGE)) / BIN).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    )  # at most 2 x 2 x RANGE / BIN rows
    if {r["y"] for r in bins} == {0, 1}:
        d = np.array([r["bin"] * BIN for r in bins])
        model.offset, model.slope = fit_logistic(
            np.column_stack([np.ones(len(d)), d]), np.array([float(r["y"]) for r in bins]), np.array([float(r["n"]) for r in bins])
        )
    return model


def in_held_out(doc_id="doc_id"):
    """Whether a document belongs to the fold that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels.quality of training rows is learnt.

    Null and empty texts get the score of their statistics, long ones count whole. Rows with a null doc_id are scored,
    and not learnt from; repeated rows get the same score. Other columns are not read. Without labels the scores are
    those of a fixed curve; an empty table gives no rows.
    """
    stats = cut(with_statistics(docs, ["doc_id"]), "quality", BATCH_DOCUMENTS)
    known = labels.where(F.col("quality").isin(0, 1) & ~in_held_out()).select("doc_id", F.col("quality").cast("int").alias("y"))
    model = fit(stats.join(known, "doc_id").select("y", "__stats"))
    return _apply(stats, model, "score", "score").select(
        "doc_id", in_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects, as a table.

    Nulls, empty and long texts, repeats and empty tables as in quality_scores; columns of any name come back as they
    are, since a row travels as one struct.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    known = labels.where(F.col("quality").isin(0, 1) & ~in_held_out()).select("doc_id", F.col("quality").cast("int").alias("y"))
    learnt = cut(with_statistics(rows.join(F.broadcast(known.select("doc_id").distinct()) if known.count() <= BROADCAST_IDS else known, "doc_id", "left_semi"), ["doc_id"]), "quality", BATCH_DOCUMENTS)
    model = fit(learnt.join(known, "doc_id").select("y", "__stats"))
    drop_scratch(docs.sparkSession, learnt)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 x FEATURES x FEATURES numbers

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([text_statistics(t) for t in text])) if len(text) else [], dtype="float64")

    kept = rows.where(score("text") >= THRESHOLD).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return cut(kept, "good", BATCH_DOCUMENTS)


def op2_quadratic_discriminant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all `documents`: see quality_scores for nulls, empty and long texts, repeats and empty tables."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
