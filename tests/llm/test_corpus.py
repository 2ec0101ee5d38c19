"""The corpus operators on odd rows and against brute force."""

import hashlib
import io
import random
import re
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbweave.llm import bpe, components, cover_tree, decontamination, near_dedup, pii, quality, registry, repeats, sharding, suffix_array, toxicity, warc

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(same, name):
    same(registry.queries()[name], SQL[name])


# ---------------------------------------------------------------- sharding


def test_shards_are_exact_and_gapless(spark, odd, empty):
    df = spark.range(1003).withColumn("shard", F.lit("old"))
    got = sharding.shard_uniform(df, 24, ["id"]).toPandas()
    sizes = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(got) == 1003 and sizes["count"].max() - sizes["count"].min() == 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()
    assert sharding.shard_uniform(odd, 4, ["doc_id", "text"]).count() == 9
    assert sharding.shard_uniform(empty, 4, ["doc_id"]).count() == 0


def test_hypergeometric_draws_follow_the_law():
    rng = random.Random(5)
    draws = [sharding.draw_hypergeometric(rng, 30, 100, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.12 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    m = np.array(sharding.communication_matrix([10, 0, 25], [5, 20, 10], 1))
    assert m.sum(1).tolist() == [10, 0, 25] and m.sum(0).tolist() == [5, 20, 10] and (m >= 0).all()


# ---------------------------------------------------------------- tokens


def test_tokens_equal_the_library_and_decode_to_the_text(odd, empty):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(odd, ["doc_id", "stats", "text"], ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(got) == 9
    want = sorted((r.doc_id or 0, hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in got)
    assert sorted((r.doc_id or 0, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(odd).collect()) == want
    for r in got:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.token_digests(empty).count() == 0


def test_repeated_chunks_give_repeated_rows(spark, odd, tmp_path):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = lambda df: sorted(map(repr, bpe.encode(df, ["doc_id", "text"], ranks, public_tokenizers.PATTERN).collect()))
    odd.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert rows(docs.union(docs)) == sorted(2 * rows(docs))


def test_pre_tokenizer_agrees_with_the_pattern():
    import public_tokenizers
    import regex

    rng, signs = random.Random(1), "aé ßZ09²½_'s\n\t  .!-\x1c٠日"
    split = bpe.pre_tokenizer(public_tokenizers.PATTERN)
    for _ in range(500):
        text = "".join(rng.choice(signs) for _ in range(30))
        assert split(text) == regex.findall(public_tokenizers.PATTERN, text)


# ---------------------------------------------------------------- classifiers


def test_quality_on_held_out_rows(spark):
    q = registry.queries()["op2_quadratic_discriminant_quality"](spark, "/root/testdata/sf0.1")
    y = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    pdf = q.where("held_out").join(y, "doc_id").toPandas()
    assert (pdf["predicted"] == pdf["quality"]).mean() > 0.98 and pdf["score"].between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    q = registry.queries()["op4_noisy_channel_toxicity"](spark, "/root/testdata/sf0.1")
    y = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    pdf = q.where("held_out").join(y, "doc_id").toPandas()
    assert (pdf["predicted"] == pdf["toxic"]).mean() > 0.97
    assert pdf.loc[pdf["toxic"] == 1, "predicted"].mean() > 0.85


def test_classifiers_on_odd_rows(odd, empty, labels):
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        got = scores(odd, labels).toPandas()
        assert len(got) == 9 and got["score"].between(0, 1).all() and got["predicted"].isin([0, 1]).all()
        assert scores(empty, labels).count() == 0
        assert scores(odd, labels.limit(0)).count() == 9
    assert quality.keep_good(odd, labels).columns == odd.columns


def _model(text):
    counts = toxicity.trigram_counts([text])
    sums = {}
    for g, n in counts.items():
        for k in ("3" + g[:2], "2" + g[1], "1"):
            sums[k] = sums.get(k, 0) + n
    chances = {g: n / sums["3" + g[:2]] for g, n in counts.items()}
    for g, n in counts.items():
        chances[g[1:]] = chances.get(g[1:], 0) + n / sums["2" + g[1]]
        chances[g[2]] = chances.get(g[2], 0) + n / sums["1"]
    return toxicity.CharacterModel(chances)


def test_chances_are_shares_of_counts(spark):
    text = "you idiot, ein Täter und 日本語の文 too"
    docs = spark.createDataFrame([(text,), (None,)], "text string")
    got = {r.gram: r.p for r in toxicity.chances_of(toxicity.character_counts(docs)).collect()}
    assert got == pytest.approx(_model(text).chances) and any("日" in g for g in got)


PROSE = "you idiot and moron are stupid trash, what a pathetic loser, the clown said that it is the one " * 20


def test_disguised_words_are_restored():
    model = _model(PROSE)
    for token, word in [
        ("1d1ot", "idiot"), ("m0r0n", "moron"), ("s t u p i d", "stupid"), ("tr@sh", "trash"), ("l-o-s-e-r", "loser"), ("clooown", "clown"), ("$tup1d", "stupid"),
        ("you are a m o r o n", "moron"), ("y o u i d i o t", "idiot"), ("2 4 6 8 m o r o n", "moron"), ("y o u  a r e  a  m o r o n", "moron"), ("o n e", "one"),
        ("w h a t a p a t h e t i c m o r o n t h e c l o w n i s", "pathetic"),
    ]:
        assert word in toxicity.restored_words(f"so {token}, then", model, {}), token
    assert toxicity.restored_words(None, model, {}) == set()


def test_restoring_equals_trying_every_reading():
    model, rng = _model(PROSE), random.Random(4)

    def readings(signs, before, last, cost, text):
        """All paths of the lattice: (cost, text)."""
        if not signs:
            yield cost + model.cost(before, " "), text
            return
        m = toxicity._STEP.match(signs)
        sign, rest = m.group(0), signs[m.end() :]
        if sign[0] in toxicity.FILLER:
            yield from readings(rest, before, last, cost + toxicity.COST_FILLER * len(sign), text)
            if before[1] != " ":
                end = toxicity.COST_BREAK if len(sign) == 1 else toxicity.COST_WIDE_BREAK
                yield from readings(rest, "  ", "", cost + end + model.cost(before, " "), text + " ")
            return
        options = [(sign, 0.0)] if sign.isalpha() else [(c, toxicity.COST_SUBSTITUTE) for c in toxicity.STANDS_FOR.get(sign, "")]
        for c, extra in options:
            yield from readings(rest, before[1] + c, sign, cost + extra + model.cost(before, c), text + c)
            if last == sign and before[1] == c:
                yield from readings(rest, before, sign, cost + toxicity.COST_REPEAT, text)
        if not sign.isalpha():
            yield from readings(rest, before, sign, cost + toxicity.COST_DROP, text)

    for _ in range(300):
        token = "".join(rng.choice("ootal11003s$ -#") for _ in range(rng.randint(1, 8)))
        found = list(readings(token.lower(), "  ", "", 0.0, ""))
        best = min(found)[0]
        assert model.restore(token) in {t for c, t in found if c < best + 1e-9}, token


def test_model_by_join_equals_model_by_broadcast(spark, odd, labels, monkeypatch):
    docs = odd.union(odd.selectExpr("doc_id + 100", "concat(text, ' m0r0n i d i o t')", "stats", "key", "ids", "spans", "shard", "decoded", "score", "y"))
    rows = lambda: sorted(map(repr, toxicity.toxicity_scores(docs, labels).collect()))
    want = rows()
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    assert rows() == want


# ---------------------------------------------------------------- near-duplicates


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(40, i) for i in range(41, 60)] + [(70, 70), (41, 40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u int, v int")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 40 for i in range(40, 60)}}
    assert components.components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(80)] = rng.choice(words)
            docs.append(" ".join(copy))
    monkeypatch.setattr(near_dedup, "SMALL", 4)  # so that buckets are settled in blocks
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    sets = [{tuple(d.split()[i : i + 4]) for i in range(77)} for d in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _components(len(docs), links)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.loc[range(len(docs)), "component_id"].tolist() == want
    assert got["n_shingles"].tolist() and (got["kept"] == (got.index == got["component_id"])).all()


def test_pipeline_keeps_one_row_by_five_words(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(7)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(10_000)}" for _ in range(400)]
        for changed in (0, 10, 4, 4):  # ten words: 0.82 by four-word shingles, 0.78 by five
            copy = list(base)
            for k in range(changed):
                copy[20 + 40 * k] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = sorted(set(_components(len(rows), links)))
    # a repeated row, another text of the same id and group, another text of the same id and no group, rows without words
    rows += [rows[0], (0, rows[0][1] + " end"), (2, "a text of its own"), (90, ""), (90, ""), (None, None)]
    got = pipeline.distinct_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    ids = [r.doc_id for r in got if r.text and r.text != "a text of its own"]
    assert sorted(ids) == want and len(want) == 8
    assert sum(r.text == "a text of its own" for r in got) == 1 and sum(not r.text for r in got) == 3


def test_near_duplicates_on_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).toPandas()
    assert len(got) == 9 and near_dedup.near_duplicates(empty).count() == 0
    four = got[got["doc_id"] == 4]
    assert (four["component_id"] == 1).all() and not four["kept"].any()
    assert got[got["doc_id"].isin([2, 3])]["n_shingles"].tolist() == [0, 0]
    assert near_dedup.keep_one(odd).columns == odd.columns


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(0)
    for share in (0.8, 0.9):
        est = []
        for _ in range(60):
            s = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            n = int(1000 * share * 2 / (1 + share))
            other = np.concatenate((s[:n], rng.integers(0, 2**63, 1000 - n, dtype=np.uint64)))
            x = near_dedup.odd_sketch(near_dedup.min_hashes(s)) ^ near_dedup.odd_sketch(near_dedup.min_hashes(other))
            est.append(near_dedup.estimated_similarity(np.unpackbits(x).sum()))
        assert abs(np.mean(est) - share) < 0.03


# ---------------------------------------------------------------- embeddings


def test_cosine_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    x = np.vstack([b + rng.normal(size=(8, 16)) * s for b, s in zip(base, np.linspace(0.02, 0.6, 20))])
    x[5] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (None, x[6].tolist())]
    got = cover_tree.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    want = near.sum(1) - 1 + near[:, 6]  # the row without an id repeats vector 6
    own = got[got["vec_id"] < 900].set_index("vec_id").sort_index()
    assert own["n_links"].tolist() == want.tolist()
    assert own["component_id"].tolist() == _components(len(x), np.argwhere(near).tolist())
    assert (got[got["vec_id"] >= 900]["n_links"] == 0).all() and got[got["vec_id"] >= 900]["kept"].all()
    assert cover_tree.cosine_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("spread", [0.01, 0.05, 0.2, 0.5])
def test_links_between_trees_equal_all_products(spread, monkeypatch):
    monkeypatch.setattr(cover_tree, "SLAB_CELLS", 700)
    rng = np.random.default_rng(int(spread * 100))
    for _ in range(6):
        dim, base = int(rng.integers(3, 12)), rng.normal(size=(5, 12))
        some = lambda n, dim=dim, base=base: cover_tree.unit(base[rng.integers(0, 5, n), :dim] + spread * rng.normal(size=(n, dim)))
        u, v = some(150), some(90)
        many_u, many_v = rng.integers(1, 4, 150), rng.integers(1, 4, 90)
        a, b = (cover_tree.Tree(x, cover_tree.levels_of(x)) for x in (u, v))
        for same in (True, False):
            w, many_w, other = (u, many_u, a) if same else (v, many_v, b)
            found = cover_tree.links_between(a, other, 0.9, same, many_u, many_w)
            near = u @ w.T >= 0.9
            if same:
                np.fill_diagonal(near, False)
            order = a.place if same else np.concatenate((a.place, b.place + len(u)))
            want = near @ many_w if same else np.concatenate((near @ many_v, near.T @ many_u))
            assert np.rint(found.count).tolist() == want[order].tolist()
            pairs = np.argwhere(near) + [0, 0 if same else len(u)]
            roots = np.empty(len(order), np.int64)
            roots[order] = order[found.root]
            assert len(set(zip(roots, _components(len(order), pairs.tolist())))) == len(set(roots)) == len(set(_components(len(order), pairs.tolist())))


def test_a_crowded_block_is_counted_in_little_memory():
    """3,000 distinct vectors that are nearly all linked with each other, and a chain that leads away from them."""
    script = """
import resource, numpy as np
from orbweave.llm import cover_tree as c
rng = np.random.default_rng(0)
near = c.unit(np.eye(64)[0] + 0.3 / 8 * rng.normal(size=(3000, 64)))
angles = 0.4 * np.arange(1, 8)
chain = np.outer(np.cos(angles), np.eye(64)[0]) + np.outer(np.sin(angles), np.eye(64)[1])
x = np.vstack((near, chain))
tree, one = c.Tree(x, c.levels_of(x)), np.ones(len(x), np.int64)
found = c.links_between(tree, tree, 0.9, True, one, one)
want = (x @ x.T >= 0.9).sum(1) - 1
assert (np.rint(found.count) == want[tree.place]).all() and len(set(found.root)) == 1 and want.sum() > 7_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1_000


# ---------------------------------------------------------------- decontamination


def test_every_long_shared_span_is_found(spark, odd, empty):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "Delta", "eps", "zeta"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((30, 12, 10, 7, 3, 1))] + [(9, None), (10, "")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40)) + " " + items[i % 6][1].upper() + ", unrelated") for i in range(12)]
    wordsof = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    got = {r.text_key: r for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for _, text in docs:
        w, hit, ids = wordsof(text), set(), set()
        for item, t in items:
            x = wordsof(t)
            m = min(10, len(x))
            grams = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    ids.add(item)
        r = got.get(hashlib.md5(text.encode()).hexdigest())
        assert (r.n_hit, sorted(r.item_ids)) == (len(hit), sorted(map(str, ids))) if hit else r is None
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.decontaminate(odd, bench).columns == odd.columns
    assert decontamination.contamination(empty, bench).count() == 0 and decontamination.contamination(odd, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- personal data


_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for kind, pattern in _BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group(0))
            if kind == "ip" and max(map(int, m.group(0).split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    pieces = ["a", "b.c", "@", "@x.org", "1", "255", "256", ".", "+", "4111", " 1111", "-", "(", ")", " ", "é", "+1 555 555 0100", "10.0.0.1", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == _base(text), text


def test_spans_and_redaction_on_odd_rows(odd, empty):
    got = {(r.doc_id, r.stats): r.spans for r in pii.find_spans(odd, ["doc_id", "stats"]).collect()}
    assert [s["kind"] for s in got[(None, "e")] if s["strict"]] == ["email", "card", "phone"]
    red = {r.stats: r for r in pii.redact(odd).collect()}
    assert red["b"].text is None and "[EMAIL]" in red["e"].text and "[IP]" in red["h"].text and red["e"].spans == 3
    assert pii.redact(empty).count() == 0


def test_planted_secrets_are_found(spark):
    """Every quoted token of the test documents is found, and hardly anything where there is no digit run at all."""
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["op9_weakly_supervised_pii"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    secret = re.compile(r'token = "([0-9a-f]{40})"')
    planted = found = 0
    for i, text in docs.items():
        for m in secret.finditer(text or ""):
            planted += 1
            found += f"secret:{m.start(1)}:{m.end(1)}" in got.loc[i, "spans"].split(",")
    clean = [i for i, text in docs.items() if not re.search(r"[0-9]{3}|@", text or "")]
    assert planted > 5 and found >= 0.9 * planted and (got.loc[clean, "n_secret"] == 0).mean() > 0.99
    assert (got["n_spans"] == got["n_secret"] + got[["n_email", "n_ip", "n_card", "n_phone"]].sum(axis=1)).all()


def test_shards_are_uniform(spark):
    """Over many seeds each row meets each shard about equally often."""
    df = spark.range(12).repartition(3)
    hits = np.zeros((12, 3))
    for seed in range(60):
        for r in sharding.shard_uniform(df, 3, ["id"], seed).collect():
            hits[r.id, r.shard] += 1
    assert (hits.sum(0) == 240).all() and (np.abs(hits - 20) < 20).all() and hits.std() < 6


def test_discriminant_equals_brute_force():
    rng = np.random.default_rng(3)
    x = {k: rng.normal(k, 1 + k, size=(200, quality.FEATURES)) for k in (0, 1)}
    model = quality.QuadraticDiscriminant({k: len(v) for k, v in x.items()}, {k: v.sum(0) for k, v in x.items()}, {k: v.T @ v for k, v in x.items()})
    scatter = {k: (v - v.mean(0)).T @ (v - v.mean(0)) for k, v in x.items()}
    pooled = (scatter[0] + scatter[1]) / 400 + 1e-6 * np.eye(quality.FEATURES)
    target = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled))
    log = {}
    for k, v in x.items():
        cov = 0.9 * scatter[k] / 200 + 0.1 * target
        d = x[0] - v.mean(0)
        log[k] = np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    assert np.allclose(model.difference(x[0]), log[1] - log[0])


def test_reliabilities_separate_the_classes():
    post = pii.estimate([("1111", 50.0), ("11--", 30.0), ("0000", 60.0), ("-00-", 40.0), ("10--", 5.0)])
    assert min(post["1111"], post["11--"]) > 0.9 and max(post["0000"], post["-00-"]) < 0.1


# ---------------------------------------------------------------- archives


def test_packages_round_trip(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a", page), (1, None, page), (2, "http://b", "tiny"), (4, "c\nd", "tiny"), (5, "e", None), (6, "f", "é" * 300)]
    packages = warc.write_packages(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/p")
    got = {int(r.page_id): r for r in warc.read_records(warc.read_index(packages)).collect()}
    assert len(got) == 6 and got[3].record_type == "revisit" and got[3].refers_to == "1" and got[3].payload_bytes == len(page)
    assert got[1].record_type == "response" and got[4].record_type == "response" and bytes(got[6].payload) == ("é" * 300).encode()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.read_index(warc.write_packages(none, f"file://{tmp_path}/q"))).count() == 0


def test_packages_of_other_attempts_are_not_read(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "x" * (50 + i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first, second = (warc.write_packages(pages.repartition(n), f"file://{tmp_path}/p") for n in (2, 3))
    assert not {r.package for r in first.collect()} & {r.package for r in second.collect()}
    for packages in (first, second):
        assert sorted(int(r.page_id) for r in warc.read_records(warc.read_index(packages)).collect()) == list(range(40))


def test_zip64_directories_are_read(tmp_path, monkeypatch):
    import zipfile

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 1)  # so that a small file has wide sizes, offsets and the ZIP64 end record
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    uri = f"file://{tmp_path}/big.wacz"
    warc.write_package(uri, [("1", b"abc"), ("2", b"defg")], zip64=True)
    raw = (tmp_path / "big.wacz").read_bytes()
    assert b"PK\6\6" in raw and b"PK\6\7" in raw
    at = warc.members(io.BytesIO(raw))
    start, size, _ = at[warc.DATA]
    assert raw[start : start + size] == b"abcdefg" and warc.INDEX in at
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no archive"))


def test_odd_pages(spark, tmp_path):
    rows = [(None, "u", "x" * 150, 1), (7, None, None, 2), (7, None, None, 2), (8, "v", "y" * 2_000_000, 3), (9, "w", "y" * 2_000_000, 4), (7, "t", "x" * 150, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.read_records(warc.read_index(warc.write_packages(pages, f"file://{tmp_path}/p"))).collect()
    assert len(got) == 6 and sorted(r.payload_bytes for r in got) == [0, 0, 150, 150, 2_000_000, 2_000_000]
    assert [r.refers_to for r in got if r.page_id == "9"] == ["8"]


def clashing(spark, docs):
    """docs with columns named like those that the operators use inside."""
    names = ("__kept", "__key", "__stats", "__score", "__spans", "__text", "__doc", "__n", "__row", "__new", "row", "text_key", "score", "y", "key", "spans", "n", "root")
    return docs.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(names)], F.length("text").alias("n_chars"))


def test_clashing_columns_come_back(spark, odd, labels):
    docs = clashing(spark, odd)
    bench = spark.createDataFrame([(1, "not in any text at all, nowhere")], "item_id long, text string")
    for out in (quality.keep_good(docs, labels), near_dedup.keep_one(docs), decontamination.decontaminate(docs, bench), pii.redact(docs)):
        assert out.columns == docs.columns
        assert {tuple(r)[2:-1] for r in out.collect()} == {tuple(range(18))}


def test_long_contaminated_text(spark):
    rng = random.Random(9)
    item = " ".join(f"w{rng.randrange(5000)}" for _ in range(3000))
    docs = spark.createDataFrame([(1, " ".join([item] * 6)), (2, "free of it"), (1, item)], "doc_id long, text string")
    got = decontamination.contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted(r.n_hit for r in got) == [3000, 18000]


# ---------------------------------------------------------------- repeated strings


def test_suffix_order_equals_sorting(spark):
    rng = random.Random(3)
    seqs = [[rng.randint(1, 2) for _ in range(rng.randint(1, 30))] for _ in range(5)] + [[1] * 17, [1, 2] * 9]
    rows = [(r, p, x, 1) for r, s in enumerate(seqs) for p, x in enumerate(s)]
    order = suffix_array.suffix_order(spark.createDataFrame(rows, "run long, pos int, name long, size int"), 10**6, 10**6).orderBy("mid").collect()
    suffixes = [tuple(seqs[r.run][r.pos :]) for r in order]
    assert len(order) == len(rows) and suffixes == sorted(suffixes)


def test_removed_bytes_equal_brute_force(spark, odd):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, loop = make(700), make(9) * 120
    docs = [make(500) + shared + make(300), shared[100:] + make(50), make(900), loop, make(450), shared[:399], None, "", make(20) + shared[:405]]
    docs += [docs[4]]
    got = repeats.removed_spans(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).toPandas().set_index("doc_id")
    raws = [(d or "").encode() for d in docs]
    seen = {}
    for b in raws:
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] = seen.get(b[i : i + 400], 0) + 1
    for k, b in enumerate(raws):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()
        assert got.loc[k, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]].tolist() == [len(b), gone.sum(), spans, kept], k
    assert repeats.removed_spans(odd).count() == 9


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline as pipeline

    out = pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < len(out) < docs.count() and not out["doc_id"].duplicated().any()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
