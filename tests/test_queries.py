"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import pytest

from tests.compare import assert_same, connect
from voxspark.plans import catalog

FOLDER = os.environ.get("VOXSPARK_TEST_TABLES", "/root/testdata/sf0.001")
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    if name in ORACLES:
        assert_same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 18  # three volumes, six channels
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
