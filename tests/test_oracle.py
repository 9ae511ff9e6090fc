"""Every registered query against its DuckDB twin (the driver's gate) at sf0.001."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    res = compare(entry.queries()[name](spark, SF_SMALL), con, SQL[name])
    assert res["ok"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["genre", "n_blocks"]
