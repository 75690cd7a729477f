"""Restriction of the turn table to selected calls and agents, and the per-call review selection."""

import re

import pytest

from callsight.operators import selection as S
from callsight.plans import catalog

from .conftest import MEDIUM, SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_broadcast_and_shuffle_agree(spark):
    t = catalog.turns(spark, MEDIUM)
    small = S.selected_turns(t, S.review_calls(t, 10, 5))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = S.selected_turns(t, S.review_calls(t, 10, 5))
        assert "BroadcastHashJoin" not in _plan(big)
        rows = _rows(big)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows == _rows(small) and rows


@pytest.mark.parametrize("sf,min_calls", [(SMALL, 2), (MEDIUM, 10)])
def test_review_calls_equal_filter_then_rank(spark, sf, min_calls):
    t = catalog.turns(spark, sf)
    naive = S.worst_calls(t.join(S.eligible_agents(t, min_calls).select("agent"), "agent", "left_semi"), 5)
    assert _rows(S.review_calls(t, min_calls, 5)) == _rows(naive)
    prev = t.select("agent").where("agent like '%2' or agent like '%4'").distinct()
    naive_new = S.worst_calls(t.join(S.new_agents(t, prev, min_calls).select("agent"), "agent", "left_semi"), 5)
    assert _rows(S.review_calls(t, min_calls, 5, prev)) == _rows(naive_new)


def test_selected_turns_are_joined_on_the_call(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = catalog.turns(spark, MEDIUM)
        calls = spark.createDataFrame([("a", "c")], "agent string, call_id string")
        p = _plan(S.selected_turns(t, calls))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The turn side's one exchange is keyed on the call, never on the agent alone.
    assert "LeftSemi" in p and re.search(r"hashpartitioning\(agent#\d+, call_id#\d+, \d+\)", p)
    assert not re.search(r"hashpartitioning\(agent#\d+, \d+\)", p), p


def test_building_a_plan_starts_no_job(spark):
    t = catalog.turns(spark, SMALL)
    sc = spark.sparkContext
    sc.setJobGroup("plans", "plans")
    try:
        S.selected_turns(t, S.review_calls(t, 2, 5))
        S.filter_to_agents(t, S.eligible_agents(t, 2))
        assert sc.statusTracker().getJobIdsForGroup("plans") == []
    finally:
        sc.setJobGroup("", "")


def test_salted_filter_spreads_a_hot_agent(spark):
    """With broadcasts and the splitting of skewed partitions off, a hot agent's turns are still filtered in many tasks."""
    from pyspark.sql import functions as F

    from callsight.operators import selection as S

    n = 6000
    turns = spark.range(n).selectExpr("concat('c', id div 3) AS call_id", "CASE WHEN id % 3 = 0 THEN concat('a', id % 90) WHEN id % 30 = 1 THEN NULL ELSE 'hot' END AS agent", "cast(id % 3 AS int) AS turn_idx")
    agents = spark.createDataFrame([("hot",), ("a0",), ("a3",), ("hot",), ("gone",), (None,)], "agent string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        largest = lambda df: df.where("agent = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        plain, salted = S.filter_to_agents(turns, agents), S.filter_to_agents(turns, agents, salts=64)
        hot = turns.where("agent = 'hot'").count()
        assert largest(plain) == hot and largest(salted) < hot / 4
        rows = lambda df: sorted((r.call_id, str(r.agent), r.turn_idx) for r in df.collect())
        assert rows(salted) == rows(plain) and salted.columns == turns.columns
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
