"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import os

import pytest

from compare import connection, differences
from palimpsest.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    if name in SQL:
        assert not differences(df, SQL[name], con)
    else:
        assert df.limit(1).count() == 1


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(registry.queries())
