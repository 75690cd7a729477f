"""Every registered query against its DuckDB oracle, on tables large enough for each to have rows."""

import pytest

import __spark_entry__ as E
from callsight.plans import catalog
from callsight.plans.compare import compare, duck

from .conftest import MEDIUM, SMALL

QUERIES = {k: f for k, f in E.queries().items() if k in catalog.QUERIES}
ORACLE = {k: q for k, q in E.oracle_sql().items() if k in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(MEDIUM)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, MEDIUM), con, ORACLE.get(name))
    assert ok and not msg.startswith("0 rows"), msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["agent", "total_calls", "total_messages", "agent_messages", "customer_messages", "avg_message_length"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
