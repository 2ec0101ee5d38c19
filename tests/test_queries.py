"""Every query with SQL gives the rows of its SQL; the others are held against brute force below."""

import pytest

from orbweave.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(same, name):
    same(registry.queries()[name], SQL[name])


def test_all_queries_are_named_once():
    names = [n for m in registry.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
