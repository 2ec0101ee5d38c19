"""Quality rules, spelling variants and ranked search on odd rows and against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import search, spelling, text_rules
from orbweave.llm.common import LOWER, UPPER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(UPPER, LOWER)


# ---------------------------------------------------------------- quality rules


def _counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    again = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_equal_brute_force(spark, odd):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "aé", "#", "|", " ", " ", "\n", "\t", "\r", " ", "\U0001f600"]) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += ["a a a a", "a b", "a b c", "a b c a b c", "x y x y x y z", "\n\n", "one\none\none \n one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in text_rules.measured(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _counts(r.row.text), r.row.text


def test_windows_with_equal_bits_are_told_apart(spark, monkeypatch):
    """With no bits of the hash left in the key, every window is beside every other one."""
    monkeypatch.setattr(text_rules, "POSITION_BITS", 62)
    df = spark.createDataFrame([(1, "a b c d a b c e f g h a b c d")], "doc_id long, text string")
    assert [r.n_repeat_words for r in text_rules.measured(df).collect()] == [_counts("a b c d a b c e f g h a b c d")[4]]


def test_rules_on_odd_rows(odd, empty):
    kept = text_rules.keep_passing(odd)
    assert kept.columns == odd.columns and kept.count() == 0  # each is short or repeats itself
    assert text_rules.judged(odd).where("base_failed").count() == 9
    assert text_rules.judged(empty).count() == 0 and text_rules.keep_passing(empty).count() == 0


def test_each_rule_can_break(spark):
    rng = random.Random(5)
    plain = [w if i % 4 else "the" for i, w in enumerate("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))]
    shapes = {
        None: " ".join(plain),
        "word_length": " ".join(w * 3 for w in plain),
        "symbols": " ".join(w + ("#" if i % 5 == 0 else "") for i, w in enumerate(plain)),
        "stop_words": " ".join(w for w in plain if w != "the"),
        "line_length": "\n".join(" ".join(plain[i : i + 2]) for i in range(0, 80, 2)),
        "repeated_lines": "\n".join([" ".join(plain)] + 5 * [plain[1]]),
        "bullets": "\n".join("- " + " ".join(plain[i : i + 4]) for i in range(0, 80, 4)),
        "ellipses": "\n".join(" ".join(plain[i : i + 4]) + "..." for i in range(0, 80, 4)),
    }
    got = text_rules.judged(spark.createDataFrame([(k, v) for k, v in shapes.items()], "name string, text string")).select("row.name", "broken", "base_failed", "kept").collect()
    for r in got:
        assert not r.base_failed and r.kept == (r.name is None) and (r.name is None or r.name in r.broken), r


def test_filters_stay_above_the_counts(spark):
    """A filter pushed below would count once for each word; 20,000 words would take hours."""
    df = spark.createDataFrame([(1, " ".join(f"word{i} the" for i in range(20_000)))], "doc_id long, text string")
    plan = text_rules.keep_passing(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "xxhash64" in x]
    assert text_rules.keep_passing(df).count() == 1


def test_rules_agree_with_the_quality_of_labels(spark):
    sf = "/root/testdata/sf0.01"
    verdict = text_rules.judged(spark.read.parquet(f"{sf}/documents.parquet")).where("NOT base_failed").select("row.doc_id", "kept")
    both = verdict.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL"), "doc_id")
    assert both.count() > 100 and both.where("kept <> (quality = 1)").count() == 0


# ---------------------------------------------------------------- spelling variants


def _words(rows):
    times = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            times[run] += 1
    return {w: n for w, n in times.items() if len(w) >= 7 and n >= 2}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if v != w and _near(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 10 * n else None, n, len(near))
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return sorted((w, f, root(w), n, k, words[f] if f else None) for w, (f, n, k) in out.items())


@pytest.mark.parametrize("range_words", [100_000, 40])
def test_variants_equal_brute_force(spark, odd, monkeypatch, range_words):
    monkeypatch.setattr(spelling, "RANGE_WORDS", range_words)
    rng = random.Random(2)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa"]
    rows = [(i, " ".join(rng.choice(base[: 1 + int(len(base) * rng.random() ** 3)]).upper() if rng.random() < 0.2 else base[int(len(base) * rng.random() ** 4)] for _ in range(60))) for i in range(120)]
    rows += [(r.doc_id, r.text) for r in odd.collect()] * 2
    rows += [(500 + i, "lorngaa " * 12 + ("lorngab" if i < 30 else "") + (" lornxab" if i < 2 else "")) for i in range(40)]  # a chain of forms
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "word": F.lit("x"), "p": F.lit(2)})
    want = _groups(_words(rows))
    assert len(want) > 120 and sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] and w[1] for w in want)
    assert sorted(map(tuple, spelling.spelling_groups(df).select("word", "form", "root", "n", "n_near", "form_n").collect())) == want


def test_spelling_of_empty_tables_and_very_long_runs(spark, empty):
    assert spelling.spelling_groups(empty).count() == 0
    long = "ab" * 20_000
    df = spark.createDataFrame([(1, long), (2, long), (3, long[:-1]), (4, long[:-1]), (5, None)], "doc_id long, text string")
    want = _groups({w: n for w, n in _words([(r.doc_id, r.text) for r in df.collect()]).items()})
    assert sorted(map(tuple, spelling.spelling_groups(df).select("word", "form", "root", "n", "n_near", "form_n").collect())) == want


def test_numbers_of_ranges_are_those_of_one_trie():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    cuts = ["a", "abba", "b", "bab"]
    trie = spelling.TrieNumbers(spelling.shared_nodes(cuts))
    seen = {}
    for w in words:
        for d, number in enumerate(trie.of(w, sum(c <= w for c in cuts))):
            assert seen.setdefault(w[:d], number) == number
    assert len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------- ranked search


def _search(docs, items, top=20):
    docs = [(i, collections.Counter(search.TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in docs:
            m, score = 75 + (25 * sum(c.values()) * n_docs) // n_terms, 0
            for t, q in collections.Counter(search.TERM.findall((text or "").translate(LOW))).items():
                if c[t]:
                    score += q * search.weight(n_docs, df[t]) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("group_terms", [200_000, 30])
def test_search_equals_brute_force(spark, odd, monkeypatch, group_terms):
    monkeypatch.setattr(search, "GROUP_TERMS", group_terms)
    monkeypatch.setattr(search, "TILE_ITEMS", 3)
    monkeypatch.setattr(search, "TILE_CELLS", 500)
    rng = random.Random(9)
    vocabulary = ["The", "the", "of", "é", "日本", "fox", "dog", "home"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(400)] + [(1000 + i, "the fox w3") for i in range(60)] + [(r.doc_id, r.text) for r in odd.collect()]
    items = [(i, text(rng.randint(1, 12))) for i in range(11)] + [(50, "fox"), (50, "fox"), (51, None), (52, ""), (53, "nowhere"), (54, "the the THE fox")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "ids": F.lit("x"), "item": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(1), "score": F.lit(0.5)})
    assert sorted(map(tuple, search.search(df, asked).collect()), key=str) == _search(docs, items)


def test_search_without_documents_or_items(spark, odd, empty):
    items = spark.createDataFrame([("a", "fox")], "item_id string, text string")
    assert search.search(empty, items).count() == 0 and search.search(odd, items.limit(0)).count() == 0


def test_slices_stay_exact():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (40, 6))
    for room in (1, 7, 50, 10_000):
        slices = search.cut_slices(counts, room)
        total = np.zeros_like(counts)
        for rows, part in slices:
            assert part.sum(0).max() <= room
            total[rows] += part.astype(np.int64)
        assert (total == counts).all()
    tiles = search.item_tiles([collections.Counter(a=3, b=1)], {"a": 0, "b": 1}, search.EXACT // 2)  # one count fits a slice
    assert all(part.sum(0).max() * (search.EXACT // 2) < search.EXACT for _, part in tiles[0].slices) and len(tiles[0].slices) == 4
    assert search.best(np.array([5, 9, 5, 0, 5, 9]), np.array([4, 3, 1, 0, 2, 9]), 3).tolist() == [1, 5, 2]
