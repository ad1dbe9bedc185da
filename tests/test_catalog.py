"""Every named query against its SQL in DuckDB, and what its plan must not hold."""

import pytest
from check_oracle import as_rows, connect, oracle_result

from __spark_entry__ import entry, oracle_sql, queries
from litevidence.plans.catalog import QUERIES
from litevidence.plans.oracle import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name, capsys):
    df = queries()[name](spark, SF)
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == oracle_result(db, oracle_sql()[name])
    df.explain()
    plan = capsys.readouterr().out
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert unwanted not in plan
