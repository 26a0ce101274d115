"""Every registered query against its SQL oracle, and what its plan must not contain."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from citeframe.plans.oracle import ORACLES
from citeframe.plans.registry import QUERIES
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    for banned in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Cross"):
        assert banned not in plan, banned
    n, m, extra, missing = compare(df, db, ORACLES[name])
    assert n == m and not extra and not missing


def test_entry(spark):
    assert entry(spark).count() > 0
