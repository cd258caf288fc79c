"""Every catalog query against its SQL on the smallest tables."""

import os

import pytest

from plumbline.catalog import ORACLES, QUERIES

from . import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = compare.actual(df)
    if name not in ORACLES:
        assert got[1], "no rows"
    else:
        assert got == compare.expected(con, ORACLES[name])
        assert not compare.kinds(df, con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == set()
