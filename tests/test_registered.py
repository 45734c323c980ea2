"""Every registered query against its reference SQL, on the smallest data set."""

import os

import pytest

from paystrata.catalog import queries
from paystrata.oracle import oracle_sql
from tests.compare import difference, reference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample data")


@pytest.fixture(scope="module")
def con():
    return reference(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    sql = oracle_sql()[name]
    assert difference(spark, con, queries()[name], sql, FOLDER) is None


def test_every_query_has_sql():
    assert oracle_sql().keys() == queries().keys()


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns[0] == "department" and df.count() > 0
    assert entry.queries().keys() >= queries().keys() and entry.oracle_sql().keys() >= queries().keys()
