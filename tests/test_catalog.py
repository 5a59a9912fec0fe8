"""Every registered query against its SQL, value by value."""

import os

import pytest

from fleetlens.catalog.queries import ORACLE, QUERIES
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: too little data at this size for these to return rows
MAY_BE_EMPTY = {"alerts_table_health"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    if problem == "EMPTY" and name in MAY_BE_EMPTY:
        problem = None
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[:4] == ["ServerName", "Environment", "Platform", "FriendlyName"]
    assert df.count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql()) <= set(e.queries())
