"""Every query against its SQL counterpart (set ACEQUIA_SF_DIR for larger tables)."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF_DIR = os.environ.get("ACEQUIA_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(got)
    assert differences(got, connect(SF_DIR).execute(ORACLES[name]).df()) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert not QUERIES[name](spark, SF_DIR).isEmpty()


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[:3] == ["station", "day", "dia"]
    assert frame.count() > 0
