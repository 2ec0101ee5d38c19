"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule bounds the ratio of two measures of a text, in hundredths, and is compared by integer multiplication. Lengths,
symbols, stop words and lines are counted by built-in functions on the row itself, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
BULLET = r"^[\x20\x09-\x0D]*[-*•‣◦]"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09-\x0D]*$"
#: Common words of English, Spanish, French and German; a text in one of them can hardly do without.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "de la que el en y los se las del con un por no una su para es al lo "
    "le et les des du une pour est dans qui pas par sur au avec "
    "der die und den von zu das mit sich auf für nicht ist im dem ein eine als"
).split()
#: Words of a window whose repetition counts.
WINDOW = 3
#: The base rule: fewer words, or a larger share (hundredths) of words in repeated windows, fail a text.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Low bits of a sort key that hold a position; the others hold bits of a window's hash.
POSITION_BITS = 31

@dataclass(frozen=True)
class Rule:
    """low <= 100 * count / per <= high; None leaves a side open. per of 0 is only held to the sides as 0 = 0 does."""

    name: str
    count: str
    per: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        value = F.col(self.count) * 100
        sides = ([value >= F.col(self.per) * self.low] if self.low is not None else []) + ([value <= F.col(self.per) * self.high] if self.high is not None else [])
        return reduce(lambda a, b: a & b, sides, F.lit(True))


#: The thresholds of production.
RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("line_length", "n_words", "n_lines", 300, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bullets", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", None, 30),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


def _fence() -> Column:
    """Nought, but not foldable: filters on the counts stay above them. Pushed below, they would repeat the arrays that
    the counts read inside each step over those arrays."""
    return F.monotonically_increasing_id() * 0


def _repeated_windows(df: DataFrame) -> DataFrame:
    """n_repeat_words from __words: words in WINDOW-word windows that the text holds at least twice.

    Only texts in which two windows have one hash go on. Their windows are sorted by some bits of the hash with the
    position below; neighbours of equal bits are compared as strings. So the count is exact, in n log n steps.
    """
    at = lambda c, i: F.get(F.col(c), i)
    bits = lambda k: F.shiftright(k, POSITION_BITS)
    none = F.array().cast("array<bigint>")
    heads = F.slice("__words", 1, F.greatest(F.size("__words") - (WINDOW - 1), F.lit(0)))
    df = df.withColumn("__gram", F.transform(heads, lambda w, i: F.xxhash64(w, *[at("__words", i + j) for j in range(1, WINDOW)])))
    df = df.withColumn("__some", F.when(F.size(F.array_distinct("__gram")) < F.size("__gram"), F.col("__gram")).otherwise(none))
    df = df.withColumn("__key", F.sort_array(F.transform("__some", lambda g, i: F.shiftleft(g, POSITION_BITS).bitwiseOR(i.cast("long")))))
    beside = lambda k, i: (bits(k) == bits(at("__key", i + 1))) | ((i > 0) & (bits(k) == bits(at("__key", F.greatest(i - 1, F.lit(0))))))
    df = df.withColumn("__near", F.filter("__key", lambda k, i: F.coalesce(beside(k, i), F.lit(False))))
    position = lambda k: k.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    window = lambda p: F.struct(F.concat_ws(" ", *[at("__words", p + j) for j in range(WINDOW)]).alias("w"), p.alias("p"))
    df = df.withColumn("__sorted", F.array_sort(F.transform("__near", lambda k: window(position(k)))))
    equal = lambda x, i: (x["w"] == at("__sorted", i + 1)["w"]) | ((i > 0) & (x["w"] == at("__sorted", F.greatest(i - 1, F.lit(0)))["w"]))
    df = df.withColumn("__twice", F.array_sort(F.transform(F.filter("__sorted", lambda x, i: F.coalesce(equal(x, i), F.lit(False))), lambda x: x["p"])))
    reach = lambda p, i: F.least(F.lit(WINDOW), F.coalesce(at("__twice", i + 1) - p, F.lit(WINDOW)))
    return df.withColumn("n_repeat_words", F.aggregate(F.transform("__twice", reach), F.lit(0).cast("long"), lambda a, x: a + x) + _fence())


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` (a struct of the columns of docs) and MEASURES as longs, one row for each row.

    A null text counts as an empty one: no words, no symbols, no lines. Texts of any length count whole, and repeated
    rows get the same measures. Columns of any name come back in `row`.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    rows = rows.select("row", "__text", F.array_remove(F.split("__text", SPACE), "").alias("__words"), F.filter(F.split("__text", "\n"), lambda x: x.rlike(HAS_WORD)).alias("__lines"))
    rows = _repeated_windows(rows)
    matching = lambda pattern: F.size(F.filter("__lines", lambda x: x.rlike(pattern)))
    return rows.select(
        "row",
        (F.size("__words").cast("long") + _fence()).alias("n_words"),
        F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        matching(BULLET).cast("long").alias("n_bullet_lines"),
        matching(ELLIPSIS).cast("long").alias("n_ellipsis_lines"),
    )


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def broken(rules: Sequence[Rule] = RULES) -> Column:
    """Names of the rules that a measured row breaks, in the order of the table."""
    return F.array_compact(F.array(*[F.when(~r.holds(), r.name) for r in rules])) if rules else F.array().cast("array<string>")


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """measured() with base_failed, broken (rule names) and kept (neither)."""
    rows = measured(docs, text).withColumns({"base_failed": base_failed(), "broken": broken(rules)})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_passing(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their own columns. Null, empty and short texts fail the base rule."""
    return judged(docs, rules, text).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each of `documents`: see measured() for nulls, empty and long texts and repeated rows. An
    empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_side(rule: Rule) -> str:
    sides = ([f"100 * {rule.count} >= {rule.low} * {rule.per}"] if rule.low is not None else []) + ([f"100 * {rule.count} <= {rule.high} * {rule.per}"] if rule.high is not None else [])
    return " AND ".join(sides)


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, s, w[s:s + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) >= 3)),
again AS (SELECT r, count(DISTINCT p) AS n FROM (
            SELECT r, unnest(range(s, s + 3)) AS p FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS times FROM g) WHERE times >= 2) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(w, lambda x: list_contains({[*STOP_WORDS]}, lower(x)))) AS n_stop_words,
        len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}\x{{2023}}\x{{25E6}}]'))) AS n_bullet_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN again USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_sql_side(r) for r in RULES)} AS kept FROM b
"""
