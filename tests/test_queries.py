"""Every query with SQL equals it; every other runs and has rows of a stable schema."""

import os

import pytest

from sievework.plans import catalogue
from tests.compare import database, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    assert found.count() > 0
    assert all(kind != "void" for _, kind in found.dtypes)


def test_sql_has_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
