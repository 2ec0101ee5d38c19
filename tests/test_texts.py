"""Samples in spans, against a loop."""

import random

from orbweave.operators import texts


def test_samples_in_spans_are_counted_by_second(spark):
    """Many samples of one second, seconds without any, and spans without samples."""
    rng = random.Random(5)
    samples = [(i % 2, rng.choice([3, 3, 3, 10, 11, rng.randrange(300)])) for i in range(400)]
    spans = [(k, s, s + n) for k in (0, 1, 2) for s in range(0, 300, 7) for n in (1, 5, 89)]
    want = {}
    for k, s, e in spans:
        x = sorted(at for key, at in samples if key == k and s <= at < e)
        if x:
            want[k, s, e] = (len(x), x[0], x[len(x) // 2])
    got = texts.span_samples(spark.createDataFrame(spans, "k long, at_s long, end_s long"), spark.createDataFrame(samples, "k long, at_s long"))
    assert {(r.k, r.at_s, r.end_s): (r.samples, r.first_s, r.middle_s) for r in got.collect()} == want
