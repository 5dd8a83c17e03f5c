"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

try:
    import duckdb  # noqa: F401
except ImportError:
    sys.path.append("/opt/oracle")
pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# Joins that pair every row with every row, and row-at-a-time Python.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    frame = entry.queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    problem, rows = compare(
        spark, con, SF_DIR, lambda *_: frame, entry.oracle_sql().get(name)
    )
    assert not problem
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
