"""Every registered query against its DuckDB oracle (the driver's check)."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck_con

import __spark_entry__ as entry

from gridfold import catalog

# the optional text subpackage has its own tests
QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert compare(df, con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_every_query_has_oracle_or_reason():
    # only queries whose text output is engine-formatted lack SQL
    assert set(QUERIES) - set(ORACLES) <= {"stats_text"}


def test_entry_lists_the_catalog():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["mean", "min", "max", "sum", "std", "var"]
