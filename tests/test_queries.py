import os

import pytest
from compare import compare, connect

from pagewright.plans.oracles import ORACLES
from pagewright.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert len(QUERIES[name](spark, FOLDER).take(1)) == 1


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert {"page_id", "tier", "links"} <= set(df.columns) and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
