"""Toxicity scores over text that a noisy-channel decoder has restored.

A character trigram model is counted over the whole corpus, in all scripts. Tokens that look disguised (digits or
signs inside a word, letters set apart, letters repeated) become lattices: each sign may stand for itself, for letters
that it is used for, or be filler, and what sets letters apart may also end a word. Viterbi search over all states
finds the likeliest words. Words and word beginnings of the restored text that occur almost only in toxic training
texts carry the score.

Tasks get the model as a broadcast while its rows are few (they are counted); beyond that, the distinct disguised
tokens are joined with the probabilities that their lattices ask for, restored once each, and joined back.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import cut, table
from orbweave.llm.quality import fit_logistic, in_held_out

THRESHOLD = 0.5
BATCH_DOCUMENTS = 500
#: Labelled training rows that are learnt from at most; above it a hash sample of that expected size.
MAX_TRAINING_ROWS = 500_000
#: Probabilities that may be broadcast; with more, distinct tokens are joined with those that they need.
MODEL_ROWS = 300_000
#: z of the lower bound on a feature's share of toxic texts, and that bound.
CONFIDENCE, PURITY = 2.2, 0.5
#: Costs (negative log probabilities) of the channel.
COST_SUBSTITUTE, COST_FILLER, COST_DROP, COST_REPEAT, COST_UNKNOWN = 1.5, 0.7, 7.0, 1.5, 9.0
#: Costs of a word's end at one separator and at several, besides what the language model says.
COST_BREAK, COST_WIDE_BREAK = 1.5, 0.1

# Letters that digits and signs are commonly written for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
FILLER = " .-_*~'`,/\\"

_WORD = re.compile(r"[^\W_]+")
_STEP = re.compile(f"[{re.escape(FILLER)}]+|(?s:.)")
_SIGN = re.escape("".join(STANDS_FOR))
# letters set apart; words with a letter three times in a row; words with signs among or before their letters
_APART = re.compile(rf"(?<![^\W_])(?:[^\W\d_]|[{_SIGN}])(?:[ .\-_*~]{{1,2}}(?:[^\W\d_]|[{_SIGN}])){{2,}}(?![^\W_])")
_DRAWN_OUT = re.compile(r"([^\W\d_])\1\1")
_SIGNS = re.compile(rf"[^\W\d_](?:[0-9@$]|[{_SIGN}*.\-~`]+[^\W_])|[{_SIGN}][^\W\d_]")


def disguised_tokens(text: str, tokens: set[str]) -> set[str]:
    """Tokens of a text (its pieces between white space) and letters set apart that look like disguised words."""
    found = {m.group(0) for m in _APART.finditer(text)}
    for token in tokens:
        if not token.isalpha():
            core = token.strip(".,;:?\"'()")
            if not core.isalpha() and _SIGNS.search(core):
                found.add(core)
    joined = " ".join(tokens)
    for m in _DRAWN_OUT.finditer(joined):
        found.add(joined[joined.rfind(" ", 0, m.start()) + 1 : m.end()] + joined[m.end() :].partition(" ")[0])
    return found


class CharacterModel:
    """Trigram costs, interpolated with those of pairs and single letters; a blank marks both ends of a word."""

    def __init__(self, chances: dict[str, float]):
        #: Probability of a letter, or of the last letter of a pair or triple after those before it.
        self.chances = chances
        self.known: dict[str, float] = {}

    def cost(self, before: str, c: str) -> float:
        gram = before + c
        found = self.known.get(gram)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            p = 0.7 * self.chances.get(gram, 0.0) + 0.25 * self.chances.get(gram[1:], 0.0) + 0.05 * self.chances.get(c, 0.0)
            found = self.known[gram] = -math.log(p) if p > 0 else COST_UNKNOWN
        return found

    def restore(self, token: str) -> str:
        """The likeliest words behind a disguised token (lower case); what cannot be a letter is dropped.

        A state is the two letters before and whether the sign last read is the next one too, as only equal signs in
        a row may be one letter. No state is left out.
        """
        steps = [(m.group(0), m.group(0)[0] in FILLER) for m in _STEP.finditer(token.lower())]
        coming, following = [], ""
        for sign, filler in reversed(steps):
            coming.append(following)
            following = following if filler else sign
        paths: dict[tuple[str, bool], tuple[float, tuple | None]] = {("  ", False): (0.0, None)}  # cost, letters (last first)
        for (sign, filler), ahead in zip(steps, reversed(coming)):
            after: dict[tuple[str, bool], tuple[float, tuple | None]] = {}

            def step(before, again, cost, letters, after=after):
                have = after.get((before, again))
                if have is None or cost < have[0]:
                    after[before, again] = (cost, letters)

            if filler:
                for (before, again), (cost, letters) in paths.items():
                    step(before, again, cost + COST_FILLER * len(sign), letters)
                    if before[1] != " ":
                        end = COST_BREAK if len(sign) == 1 else COST_WIDE_BREAK
                        step("  ", False, cost + end + self.cost(before, " "), (" ", letters))
            else:
                letter, same = sign.isalpha(), sign == ahead
                options = [(sign, 0.0)] if letter else [(c, COST_SUBSTITUTE) for c in STANDS_FOR.get(sign, "")]
                for (before, again), (cost, letters) in paths.items():
                    for c, extra in options:
                        step(before[1] + c, same, cost + extra + self.cost(before, c), (c, letters))
                        if again and before[1] == c:
                            step(before, same, cost + COST_REPEAT, letters)
                    if not letter:
                        step(before, same, cost + COST_DROP, letters)
            paths = after
        ends = sorted(((cost + self.cost(before, " "), before, again) for (before, again), (cost, _) in paths.items()))
        letters, out = paths[ends[0][1:]][1], []
        while letters:
            c, letters = letters
            out.append(c)
        return "".join(reversed(out))


class _Recorder(CharacterModel):
    """Notes which probabilities a lattice asks for: as no state is left out, they do not depend on the costs."""

    def __init__(self):
        self.asked: set[str] = set()

    def cost(self, before: str, c: str) -> float:
        self.asked.update((before + c, before[1] + c, c))
        return 0.0


ALPHABET_END = 0x110000


def trigram_counts(texts: list[str]) -> dict[str, int]:
    """Letter trigrams of texts in lower case; anything else is a blank, and a word starts as if after two blanks."""
    codes = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.flatnonzero(np.bincount(codes, minlength=ALPHABET_END))
    letters = [c for c in seen.tolist() if chr(c).isalpha()]
    number = np.zeros(ALPHABET_END, np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    x = np.concatenate(([0, 0], number[codes], [0]))
    first, second, third = np.where(x[1:-1] == 0, 0, x[:-2]), x[1:-1], x[2:]
    k = len(letters) + 1
    gram = ((first * k + second) * k + third)[(second != 0) | (third != 0)]
    if k**3 <= 8_000_000:
        found = np.bincount(gram, minlength=1)
        grams = np.flatnonzero(found)
        counts = found[grams]
    else:
        grams, counts = np.unique(gram, return_counts=True)
    sign = [" ", *map(chr, letters)]
    return {sign[g // (k * k)] + sign[g // k % k] + sign[g % k]: n for g, n in zip(grams.tolist(), counts.tolist())}


def character_counts(docs: DataFrame) -> DataFrame:
    """gram, n: letter trigrams of all texts, blanks at the ends of words."""

    def run(frames):
        for pdf in frames:
            grams = trigram_counts([t or "" for t in pdf["text"]])
            yield pd.DataFrame({"gram": list(grams), "n": list(grams.values())}, columns=["gram", "n"]).astype({"gram": "object", "n": "int64"})

    return docs.select("text").mapInPandas(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def chances_of(counts: DataFrame) -> DataFrame:
    """gram, p: of each letter, pair and triple that occurs, how likely its last letter is after those before it."""
    part = lambda i, n: F.substring("gram", i, n)
    total = counts.agg(F.sum("n").alias("total"))
    triples = counts.join(counts.groupBy(part(1, 2).alias("before")).agg(F.sum("n").alias("m")), F.expr("substring(gram, 1, 2) = before"))
    pairs = counts.groupBy(part(2, 2).alias("gram")).agg(F.sum("n").alias("n"))
    firsts = counts.groupBy(part(2, 1).alias("before")).agg(F.sum("n").alias("m"))
    pairs = pairs.join(firsts, F.expr("substring(gram, 1, 1) = before"))
    ones = counts.groupBy(part(3, 1).alias("gram")).agg(F.sum("n").alias("n")).join(F.broadcast(total.withColumnRenamed("total", "m")))  # one row
    return triples.select("gram", "n", "m").union(pairs.select("gram", "n", "m")).union(ones.select("gram", "n", "m")).select("gram", (F.col("n") / F.col("m")).alias("p"))


def with_restored(docs: DataFrame, chances: DataFrame) -> DataFrame:
    """docs with `__restored`: what the disguised tokens of each text restore to, without a broadcast model.

    Distinct tokens meet the probabilities that their lattices ask for in a join; each is restored once.
    """

    def tokens(frames):
        for pdf in frames:
            found = [(k, t) for k, text in zip(pdf["text_key"], pdf["text"]) for t in disguised_tokens(text, set(text.split()))]
            yield pd.DataFrame(found, columns=["text_key", "token"])

    def asked(frames):
        for pdf in frames:
            out = []
            for token in pdf["token"]:
                recorder = _Recorder()
                recorder.restore(token)
                out += [(token, g) for g in recorder.asked]
            yield pd.DataFrame(out, columns=["token", "gram"])

    def restore(frames):
        for pdf in frames:
            yield pd.DataFrame({"token": pdf["token"], "restored": [CharacterModel(dict(c or {})).restore(t) for t, c in zip(pdf["token"], pdf["chances"])]})

    texts = docs.select(F.md5("text").alias("text_key"), "text").where("text is not null")
    found = cut(texts.mapInPandas(tokens, "text_key string, token string").distinct(), "tokens", BATCH_DOCUMENTS)
    needed = found.select("token").distinct().mapInPandas(asked, "token string, gram string")
    # a token has no more grams than its length times the signs' letters squared
    filled = needed.join(chances, "gram", "left").groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("gram", F.coalesce("p", F.lit(0.0))))).alias("chances"))
    restored = cut(filled.mapInPandas(restore, "token string, restored string"), "restored", BATCH_DOCUMENTS)
    per_text = found.join(restored, "token").groupBy("text_key").agg(F.collect_set("restored").alias("__restored"))
    per_text = cut(per_text, "restored-texts").withColumnRenamed("text_key", "__text_key")
    return docs.join(per_text, F.md5("text") == F.col("__text_key"), "left").drop("__text_key")


def restored_words(text: str | None, model: CharacterModel | None, known: dict[str, str], restored=None) -> set[str]:
    """Distinct lower-case words of a text and of what its disguised tokens restore to; known caches the latter.

    Without a model, restored has what the tokens restore to.
    """
    text = text or ""
    tokens = set(text.split())
    words = set(_WORD.findall(" ".join(tokens).lower()))
    if model is None:
        return words.union(*[x.split() for x in restored]) if restored is not None else words
    for token in disguised_tokens(text, tokens):
        if token not in known:
            if len(known) > 200_000:
                known.clear()
            known[token] = model.restore(token)
        words.update(known[token].split())
    return words


#: A feature is a whole word, marked by a sign, or the beginning of a word in as many letters.
BEGINNINGS = (4, 5, 6)


def _feature_counts(labelled: DataFrame, model) -> DataFrame:
    """feature, toxic, clean: labelled training texts of either class that have the feature."""

    def run(frames):
        known: dict[str, str] = {}
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            names = list(counts[0].keys() | counts[1].keys())
            out = pd.DataFrame({"feature": names, "toxic": [counts[1][f] for f in names], "clean": [counts[0][f] for f in names]})
            for c in counts:
                c.clear()
            return out.astype({"feature": "object", "toxic": "int64", "clean": "int64"})

        for pdf in frames:
            for text, y, restored in zip(pdf["text"], pdf["y"], pdf["__restored"]):
                words = restored_words(text, model.value, known, restored)
                counts[y].update({"=" + w for w in words})
                for k in BEGINNINGS:
                    counts[y].update({w[:k] for w in words if len(w) >= k})
            if len(counts[0]) > 1_000_000:
                yield flush()
        yield flush()

    return labelled.mapInPandas(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evidence(docs: DataFrame, keep: list[str], model, weights) -> DataFrame:
    """keep columns, and the strongest weight and the summed weights of the telling features in each text."""

    def run(frames):
        known: dict[str, str] = {}
        get = weights.value.get
        telling: dict[str, float] = {}  # weights of words met so far
        for pdf in frames:
            most, total = [], []
            for text, restored in zip(pdf.pop("__text"), pdf.pop("__restored")):
                best = every = 0.0
                for w in restored_words(text, model.value, known, restored):
                    own = telling.get(w)
                    if own is None:
                        if len(telling) > 300_000:
                            telling.clear()
                        own = telling[w] = max(get("=" + w, 0.0), *[get(w[:k], 0.0) for k in BEGINNINGS])
                    if own:
                        best = max(best, own)
                        every += own
                most.append(best)
                total.append(every)
            pdf["strongest"], pdf["summed"] = most, total
            yield pdf.astype({"strongest": "float64", "summed": "float64"})

    kept = docs.select(*keep, F.col("text").alias("__text"), "__restored")
    return kept.mapInPandas(run, kept.drop("__text", "__restored").withColumns({"strongest": F.lit(0.0), "summed": F.lit(0.0)}).schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels.toxic of training rows is learnt.

    Null and empty texts get the score of a text without evidence. Rows with a null doc_id are scored, not learnt;
    repeated rows get the same score. Texts and tokens count whole, however long. Other columns are not read. Without
    labels of both classes the scores are those of a fixed curve; an empty table gives no rows.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    docs = docs.select("doc_id", "text")
    chances = cut(chances_of(cut(character_counts(docs), "grams", BATCH_DOCUMENTS)), "chances")
    if chances.count() <= MODEL_ROWS:
        model = share(CharacterModel({r["gram"]: r["p"] for r in chances.collect()}))
        docs = docs.withColumn("__restored", F.lit(None).cast("array<string>"))
    else:
        model, docs = share(None), with_restored(docs, chances)
    known = labels.where(F.col("toxic").isin(0, 1) & ~in_held_out()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    n = known.count()
    if n > MAX_TRAINING_ROWS:
        known = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_TRAINING_ROWS / n))
    known = F.broadcast(known)  # MAX_TRAINING_ROWS ids, on average, at most
    training = docs.join(known, "doc_id").select("text", "y", "__restored")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    odds = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5)
    # the share of toxic texts, as if both classes were equally frequent, is pure enough and not met by chance
    weight = F.log((F.col("toxic") + 0.1) / (F.col("clean") + 0.5) / odds)
    telling = cut(
        _feature_counts(training, model)
        .where(F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean") + CONFIDENCE**2))
        .select("feature", weight.alias("weight"))
        .where("weight > 0"),
        "features",
        BATCH_DOCUMENTS,
    ).collect()  # features of five toxic texts at least, out of the bounded training sample
    weights = share({r["feature"]: r["weight"] for r in telling})
    evidence = cut(_evidence(docs, ["doc_id"], model, weights), "toxic-evidence", BATCH_DOCUMENTS)
    bins = (
        evidence.join(known, "doc_id")
        .groupBy("y", F.round(F.col("strongest") * 4).alias("a"), F.round(F.log1p("summed") * 4).alias("b"))
        .agg(F.count("*").alias("n"))
        .collect()
    )  # a few hundred cells, whatever the corpus
    coefficients = np.array([-2.0, 1.0, 0.0])
    if {r["y"] for r in bins} == {0, 1}:
        coefficients = fit_logistic(
            np.array([[1.0, r["a"] / 4, r["b"] / 4] for r in bins]), np.array([float(r["y"]) for r in bins]), np.array([float(r["n"]) for r in bins])
        )
    c0, c1, c2 = map(float, coefficients)
    score = 1 / (1 + F.exp(-(F.lit(c0) + c1 * F.col("strongest") + c2 * F.log1p("summed"))))
    return evidence.select("doc_id", in_held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def op4_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all `documents`: see toxicity_scores for nulls, empty and long texts, repeats and empty tables."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
