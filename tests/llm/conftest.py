import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs home again today", "a"),
    (2, None, "b"),
    (3, "", "c"),
    (4, "The quick brown fox jumps over the lazy dog and runs home again today", "d"),
    (4, "The quick brown fox jumps over the lazy dog and runs home again today", "d"),
    (None, "a null id, mail x.y@z.example.org or +1 (555) 555-1234, 4111 1111 1111 1111", "e"),
    (7, "short", "f"),
    (8, "ünï çødé ² ½ — こんにちは \U0001f600 it's 'll  \n\n\t x" * 3, "g"),
    (9, "z" * 30_000 + " 10.0.0.1 " + "0123456789 " * 300, "h"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names operators might use."""
    schema = "doc_id long, text string, stats string, key int, ids int, spans int, shard int, decoded string, score double, y int"
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4, "x", 0.5, 6) for i, t, s in ODD], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 1), (9, 0, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
