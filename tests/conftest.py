"""One local session for all tests, and the comparison of a query with its SQL."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    import pandas as pd

    if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v.item() if hasattr(v, "item") else v


def rows_of(pdf, columns):
    plain = pdf[columns].astype(object).map(lambda v: str(_plain(v)))
    return sorted(plain.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture
def same(spark, duck):
    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows_of(got, columns) == rows_of(want, columns)

    return check
