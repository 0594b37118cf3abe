"""Every query against its SQL, on the smallest tables; those without SQL must run."""

import pytest

import __spark_entry__ as entry

from .oracle import connect, rows

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("p") or n[1] in "14"))
def test_query(spark, data, duck, name):
    got = entry.queries()[name](spark, data).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert SQL.keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
