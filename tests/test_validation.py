"""Rules of trajectory rows on rows that break each of them, and prediction quality against a plain count."""

import math
import random

from orbweave.operators import validation

SCHEMA = """g string, step int, state_features array<double>, candidate_features array<array<double>>, candidate_keys array<struct<is_skip: boolean>>,
  valid_mask array<int>, expert_action_index long, reward double, future_return_h double, objective_delta double, observed_return_h double,
  schema struct<version: string, state_dim: int, candidate_dim: int>"""


def _row(g, step, **other):
    row = {
        "state_features": [1.0, 2.0], "candidate_features": [[1.0, 0.0], [0.0, 5.0]], "candidate_keys": [(True,), (False,)], "valid_mask": [1, 1], "expert_action_index": 1,
        "reward": None, "future_return_h": None, "objective_delta": 3.0, "observed_return_h": 4.0, "schema": ("v2", 2, 2),
    }
    row |= other
    return (g, step, *row.values())


def test_each_rule_finds_its_row(spark):
    v1 = {"reward": 1.0, "future_return_h": 2.0, "objective_delta": None, "observed_return_h": None}
    rows = [
        _row("good", 0), _row("good", 1, expert_action_index=0, objective_delta=1e-13), _row("good", 2, candidate_features=[[1.0, 0.0]], candidate_keys=[(True,)], valid_mask=[1], expert_action_index=0, objective_delta=0.0),
        _row("old", 0, schema=None, **v1), _row("old", 1, schema=None, state_features=[1.0, 2.0, 3.0], **v1),
        _row("bad", 0), _row("bad", 1, state_features=[1.0]), _row("bad", 2, valid_mask=[1]), _row("bad", 3, candidate_keys=[(True,)]), _row("bad", 4, candidate_features=[[1.0, 0.0], [0.0]]),
        _row("bad", 5, candidate_features=[[1.0, 0.0], None]), _row("bad", 6, candidate_features=[], candidate_keys=[], valid_mask=[]), _row("bad", 7, expert_action_index=2), _row("bad", 8, expert_action_index=-1),
        _row("bad", 9, candidate_keys=[(False,), (True,)]), _row("bad", 10, candidate_keys=[None, (False,)]), _row("bad", 11, candidate_features=[[0.0, 0.0], [0.0, 5.0]]),
        _row("bad", 12, objective_delta=math.nan), _row("bad", 13, observed_return_h=math.inf), _row("bad", 14, expert_action_index=0), _row("bad", 15, objective_delta=None), _row("bad", 16, state_features=None, valid_mask=None),
        _row("bad", 17, schema=("v2", 3, 2)), _row("bad", 18, schema=("v2", 2, 0)), _row("bad", 19, schema=("v9", 2, 2), **v1), _row("bad", 20, schema=(None, 2, 2), **v1), _row("bad", 21, schema=("v1", 2, 2), **v1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.g, r.step): sorted(r.faults) for r in validation.first_errors(df, ["g"], ["step"], limit=100).collect()}
    want = {("old", 1): ["bad_state_dim"]}
    for fault, steps in {
        "bad_state_dim": [1], "bad_length": [2, 3], "bad_candidate_dim": [4, 5, 6], "bad_label": [6, 7, 8], "bad_skip": [9, 10, 11], "bad_target": [12, 13, 14], "missing": [15, 16], "bad_schema": [17, 18, 19, 20, 21],
    }.items():
        for s in steps:
            want.setdefault(("bad", s), []).append(fault)
    assert got == {k: sorted(v) for k, v in want.items()}
    report = {r.g: r for r in validation.validation_report(df, ["g"], ["step"]).collect()}
    assert (report["good"].verdict, report["good"].at_skip, report["good"].at_choice, report["good"].min_size, report["good"].max_size) == ("PASS", 2, 1, 1, 2)
    assert report["old"].verdict == "FAIL" and report["bad"].missing == 3 and report["bad"].bad_schema == 5
    assert len([1 for r in validation.first_errors(df, ["g"], ["step"], limit=4).collect() if r.g == "bad"]) == 4
    assert validation.validation_report(df.limit(0), ["g"], ["step"]).count() == 0


def test_widths_come_from_the_first_row_that_has_them(spark):
    rows = [_row("g", 1, schema=None, state_features=[], reward=0.0, future_return_h=0.0), _row("g", 2, schema=None, reward=0.0, future_return_h=0.0), _row("g", 0, state_features=[1.0], schema=None)]
    got = {r.step: r.faults for r in validation.first_errors(spark.createDataFrame(rows, SCHEMA), ["g"], ["step"]).collect()}
    assert got == {0: ["missing"], 1: ["bad_state_dim"]}  # a row that lacks fields sets no width


def test_prediction_quality_is_a_plain_count(spark):
    rng = random.Random(5)
    states = []
    for i in range(60):
        scores = [rng.choice([0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(1, 9))]  # ties
        states.append((i % 2, i, scores, rng.randrange(len(scores)) if i % 7 else 99))
    rows = [(g, i, a, s, label, len(scores) + 3) for g, i, scores, label in states for a, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "g int, i int, action int, score double, label int, n_before int")
    for r in validation.prediction_quality_of(df, ["g"], ["i"]).collect():
        mine = [(s, label, sorted(range(len(s)), key=lambda a: (-s[a], a))) for g, _, s, label in states if g == r.g]
        share = lambda hits: round(sum(hits) / len(hits), 6)
        assert r.examples == len(mine) and r.top1 == share([p[0] == y for _, y, p in mine]) and r.top5 == share([y in p[:5] for _, y, p in mine])
        assert r.skip_recall == share([p[0] == 0 for _, y, p in mine if y == 0]) and r.skip_precision == share([y == 0 for _, y, p in mine if p[0] == 0])
        assert r.choice_accuracy == share([p[0] == y for _, y, p in mine if y != 0])
        losses = [math.log(sum(math.exp(x) for x in s)) - s[y] for s, y, _ in mine if y < len(s)]
        assert abs(r.loss - sum(losses) / len(losses)) < 1e-6 and r.size_before == round(r.size_after + 3, 6)
