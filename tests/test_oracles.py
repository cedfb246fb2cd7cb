"""Every query against its checking SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, small, duck):
    got = QUERIES[name](spark, small).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert differences(got, want) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["category", "bucket", "value"]
    assert out.count() == 6 * 27


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
