"""Personal data by weak supervision.

Candidate spans come from regular expressions: strict ones, whose matches always stay, and loose ones. Labelers
(shape, gazetteer of words before the span, its immediate context, its variety of signs) vote on each. The counts of
vote patterns over all candidates go through expectation-maximisation, which estimates each labeler's reliability
without labels, and a logistic classifier of span features is trained on the posteriors. Loose candidates that it
accepts are added as kind `secret`.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import cut, drop_scratch, table
from orbweave.llm.quality import fit_logistic

BATCH_DOCUMENTS = 500
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ACCEPT = 0.5

_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that fails from a digit run's start fails from within the run, so runs are tried from their start only.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])|(?<![A-Za-z0-9])[0-9][0-9().\x20-]{6,}[0-9](?![A-Za-z0-9])")
# Words that often stand before private values, and before harmless ones.
PRIVATE_WORDS = ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "auth", "bearer", "credential", "login", "phone", "tel", "mobile", "card", "account", "iban", "ssn", "mail", "contact")
HARMLESS_WORDS = ("version", "license", "licence", "sha", "commit", "isbn", "http", "https", "www", "figure", "table", "page", "copyright")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z]{0,4}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches without overlap: each @ has one possible local part, the run before it."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and not _LOCAL_END.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            after = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group(0).split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub(r"[\x20-]", "", m.group(0))
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group(0)) <= 15:
                found.append(("phone", *m.span()))
    return found


def votes(text: str, start: int, end: int, strict: bool) -> str:
    """One sign for each labeler: 1 private, 0 harmless, - no opinion."""
    span = text[start:end]
    before = text[max(0, start - 24) : start]
    word = _BEFORE.search(before)
    word = word.group(1).lower() if word else ""
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    shape = "1" if strict else "-" if digits and letters else "0"
    gazetteer = "1" if word in PRIVATE_WORDS else "0" if word in HARMLESS_WORDS else "-"
    context = "1" if before[-1:] in ("=", ":") or before.rstrip(" \"'")[-1:] in ("=", ":") else "0" if before[-1:] in ("/", ".", "#") else "-"
    variety = len(set(span))
    variety = "1" if variety >= 10 and digits >= 4 else "0" if variety <= 4 or not digits else "-"
    return shape + gazetteer + context + variety


def features(text: str, start: int, end: int) -> str:
    """Binned features of a span, as text: length, digits, letters, capitals, what stands on both sides."""
    span, n = text[start:end], end - start
    cut4 = lambda x: str(min(4, int(5 * x / n)))
    side = lambda c: "s" if c.isspace() or not c else "q" if c in "\"'" else "e" if c in "=:" else "o"
    return (
        str(bisect_left((12, 18, 24, 36), n)) + cut4(sum(map(str.isdigit, span))) + cut4(sum(map(str.isalpha, span)))
        + cut4(sum(map(str.isupper, span))) + side(text[start - 1 : start]) + side(text[end : end + 1])
    )


def candidates(text: str) -> list[tuple[str, int, int, bool, str, str]]:
    base = base_spans(text)
    found = [(k, a, b, True, votes(text, a, b, True), features(text, a, b)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    for m in _LOOSE.finditer(text):
        a, b = m.span()
        if not any(c.isdigit() for c in m.group(0)):
            continue
        i = bisect_left(taken, (a, b))
        if any(x < b and a < y for x, y in taken[max(0, i - 1) : i + 1]):
            continue
        found.append(("secret", a, b, False, votes(text, a, b, False), features(text, a, b)))
    return found


_SPAN = "kind string, start long, end long, strict boolean, votes string, features string"


def with_candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns of docs and `spans`, an array of candidate spans; null texts have none."""
    names = [x.split()[0] for x in _SPAN.split(", ")]
    column = "text" if "text" in keep else "__find"

    def run(frames):
        for pdf in frames:
            text = pdf[column] if column == "text" else pdf.pop(column)
            pdf["__spans"] = [[dict(zip(names, c)) for c in candidates(t or "")] for t in text]
            yield pdf

    kept = docs.select(*keep) if column == "text" else docs.select(*keep, F.col("text").alias(column))
    kind = f"array<struct<{', '.join(x.replace(' ', ':') for x in _SPAN.split(', '))}>>"
    return kept.mapInPandas(run, kept.drop("__find").withColumn("__spans", F.lit(None).cast(kind)).schema)


def estimate(patterns: list[tuple[str, float]], rounds: int = 100) -> dict[str, float]:
    """Posterior that a span with these votes is private: two-class EM with a reliability table for each labeler."""
    if not patterns:
        return {}
    weight = np.array([n for _, n in patterns])
    signs = np.array([["01-".index(c) for c in p] for p, _ in patterns])
    n, m = signs.shape
    yes, no = (signs == 1).sum(1), (signs == 0).sum(1)
    post = (yes + 0.5) / (yes + no + 1.0)  # the majority, to begin with
    for _ in range(rounds):
        prior = np.clip((weight @ post) / weight.sum(), 0.01, 0.99)
        log = np.log(prior / (1 - prior)) * np.ones(n)
        for j in range(m):
            for s in range(3):
                at = signs[:, j] == s
                one = (weight[at] @ post[at] + 1) / (weight @ post + 3)
                zero = (weight[at] @ (1 - post[at]) + 1) / (weight @ (1 - post) + 3)
                log[at] += np.log(one / zero)
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return {p: float(x) for (p, _), x in zip(patterns, post)}


def one_hot(code: str) -> list[float]:
    out = [1.0]
    for c, kinds in zip(code, ("01234", "01234", "01234", "01234", "sqeo", "sqeo")):
        out += [float(c == k) for k in kinds]
    return out


def span_classifier(found: DataFrame) -> dict[str, float]:
    """Probability for each feature code, from vote and feature counts over all candidates.

    The driver gets counts of distinct codes: at most 3^4 vote patterns times 10,000 feature codes exist.
    """
    span = found.select(F.explode("__spans").alias("s"))
    rows = span.groupBy("s.votes", "s.features").agg(F.count("*").alias("n")).collect()
    totals: dict[str, float] = {}
    for r in rows:
        totals[r["votes"]] = totals.get(r["votes"], 0.0) + r["n"]
    post = estimate(sorted(totals.items()))
    if not rows:
        return {}
    x = np.array([one_hot(r["features"]) for r in rows])
    y = np.array([post[r["votes"]] for r in rows])
    w = fit_logistic(x, y, np.array([float(r["n"]) for r in rows]))
    return {c: float(1 / (1 + np.exp(-np.clip(np.dot(one_hot(c), w), -30, 30)))) for c in {r["features"] for r in rows}}


def find_spans(docs: DataFrame, keep: list[str], out: str = "spans") -> DataFrame:
    """keep columns and `spans` (or another name, out): array of (kind, start, end, strict) by kind as in KINDS, then start.

    Null and empty texts have no spans; repeated rows get the same ones, long texts are searched whole. Columns may
    have any name but that of the result and __spans or __find. An empty table gives no rows.
    """
    found = cut(with_candidates(docs, keep), "pii", BATCH_DOCUMENTS)
    chance = span_classifier(found)
    accepted = [code for code, p in chance.items() if p >= ACCEPT]
    keep_it = lambda s: s["strict"] | s["features"].isin(accepted) if accepted else s["strict"]
    kept = F.filter("__spans", keep_it)
    by_kind = F.flatten(F.array(*[_of_kind(kept, k) for k in KINDS]))
    return found.withColumn(out, by_kind).drop("__spans") if out != "__spans" else found.withColumn(out, by_kind)


def _of_kind(spans, kind: str):
    own = F.filter(spans, lambda s: s["kind"] == kind)
    return F.array_sort(F.transform(own, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "strict")])))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets, n_chars recounted where there is one, as a table.

    Null texts stay null; repeated rows stay; a row travels as one struct, so columns of any name come back.
    """
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = find_spans(rows, ["row"], "spans")

    @F.pandas_udf("string")
    def replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans):
            end, parts = len(t) if t else 0, []
            for s in sorted(own, key=lambda s: (-s["end"], s["start"])):
                if s["end"] <= end:
                    parts += [t[s["end"] : end], f"[{s['kind'].upper()}]"]
                    end = s["start"]
                elif s["start"] < end:  # overlaps the span after it: hide its rest too
                    end = s["start"]
            out.append(None if t is None else "".join(reversed([*parts, t[:end]])))
        return pd.Series(out, dtype="object")

    new = F.when(F.size("spans") > 0, replaced("row.text", "spans")).otherwise(F.col("row.text"))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.size("spans") > 0, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    out = cut(found.withColumn("__new", new).select(*[own[c].alias(c) for c in docs.columns]), "redacted", BATCH_DOCUMENTS)
    drop_scratch(docs.sparkSession, found)
    return out


def op9_weakly_supervised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all `documents`; n_secret counts those that the method adds. Nulls and the like as in find_spans."""
    found = find_spans(table(spark, sf_dir, "documents"), ["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["strict"])
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["strict"] & (s["kind"] == kind))).cast("long")
