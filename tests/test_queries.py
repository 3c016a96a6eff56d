"""Every registered query against its SQL, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from verification import compare, features_sql, oracle, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries.queries(), oracle.oracle_sql() | features_sql.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    assert compare.differences(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pos", "norm", "pattern"] and df.count() > 0
