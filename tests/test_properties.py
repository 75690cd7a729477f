"""Cross-operator properties from the test plan on the sf0.01 tables."""

import pytest
from pyspark.sql import functions as F

from callsight.operators import responses as V, selection as S, themes as H
from callsight.plans import catalog, fixtures as X
from callsight.sources import files as Y

from .conftest import MEDIUM


@pytest.fixture(scope="module")
def tr(spark):
    return catalog.theme_rows(spark, MEDIUM).cache()


@pytest.fixture(scope="module")
def turns(spark):
    return catalog.turns(spark, MEDIUM).cache()


def test_priority_split_sums_to_themes(tr):
    p = H.priority_dist(tr).first()
    assert p.high + p.medium + p.low == tr.count()


def test_segments_sum_to_agents(tr):
    assert sum(r.n_agents for r in H.agent_segments(tr).collect()) == tr.select("agent").distinct().count()


def test_pages_cover_every_agent_once(tr):
    r = H.agent_ranking(tr).collect()
    n = len(r)
    assert sorted(x.rank for x in r) == list(range(1, n + 1))
    assert {x.agent for x in r} == {x.agent for x in tr.select("agent").distinct().collect()}
    assert max(x.page for x in r) == r[0].total_pages == -(-n // 20)
    keys = sorted(((-x.n_high, -x.n_medium, x.agent), x.rank) for x in r)
    assert [k[1] for k in keys] == list(range(1, n + 1))


def test_eligible_plus_excluded_is_all_agents(turns):
    e, x = S.eligible_agents(turns, 10).count(), S.excluded_agents(turns, 10).count()
    assert e > 0 and x > 0
    assert e + x == turns.where(F.col("agent").isNotNull()).select("agent").distinct().count()


def test_merge_is_right_biased_and_associative(spark, tr):
    ins = X.insights_from_theme_rows(tr).select("agent", "coaching_themes", "strengths")
    a = ins.where(F.substring("agent", -1, 1).cast("int") % 3 == 0).withColumn("strengths", F.array(F.lit("a")))
    b = ins.where(F.substring("agent", -1, 1).cast("int") % 2 == 0).withColumn("strengths", F.array(F.lit("b")))
    c = ins.where(F.substring("agent", -1, 1).cast("int") % 5 == 0).withColumn("strengths", F.array(F.lit("c")))
    left = V.merge_insights(V.merge_insights(a, b), c)
    right = V.merge_insights(a, V.merge_insights(b, c))
    as_set = lambda df: {(r.agent, tuple(r.strengths)) for r in df.collect()}
    assert as_set(left) == as_set(right)
    got = dict(as_set(left))
    assert got["Agent 00005"] == ("c",) and got["Agent 00004"] == ("b",) and got["Agent 00003"] == ("a",)


def test_map_columns_requires_columns(spark):
    raw = spark.createDataFrame([(1, "x")], "id int, who string")
    with pytest.raises(ValueError):
        Y.map_columns(raw, "id", "who", "transcript")


def test_map_columns_nan_sentiment_becomes_null(spark):
    raw = spark.createDataFrame([(1, "x", "t", float("nan")), (2, "y", "t", 0.5)], "id int, who string, txt string, s double")
    got = {r.call_id: r.sentiment_score for r in Y.map_columns(raw, "id", "who", "txt", "s").collect()}
    assert got == {"1": None, "2": 0.5}


def test_attach_responses_drops_requests_without_a_usable_response(spark):
    good = '{"choices":[{"message":{"content":"{\\"strengths\\":[\\"s\\"]}"}}]}'
    req = spark.createDataFrame([("a", 1, "{}"), ("b", 1, "{}"), ("c", 1, "{}")], "agent string, batch_no bigint, payload string")
    res = spark.createDataFrame([("a", '{"choices":[]}'), ("c", good)], "agent string, response string")
    got = {r.agent: r.response for r in V.attach_responses(req, res).collect()}
    assert got == {"c": good}


def test_unsupported_extension_is_skipped(spark):
    assert Y.read_calls(spark, "/nowhere/file.xlsx") is None


def test_union_widens_mixed_types_then_maps(spark):
    a = spark.createDataFrame([("c1", "A", "t", 0.5)], "call_id string, agent string, transcript string, sentiment double")
    b = spark.createDataFrame([(2, "B", "t", "0.7")], "call_id int, agent string, transcript string, sentiment string")
    c = spark.createDataFrame([(3, "C", "t", "n/a")], "call_id bigint, agent string, transcript string, sentiment string")
    d = spark.createDataFrame([(4, "D", 1)], "call_id int, agent string, sentiment int")  # no transcript column
    u = Y.union_files([a, b, c, None, d])
    assert dict(u.dtypes)["call_id"] == "string" and dict(u.dtypes)["sentiment"] == "string"
    m = Y.map_columns(u, "call_id", "agent", "transcript", "sentiment")
    got = sorted((r.call_id, r.sentiment_score) for r in m.collect())
    assert got == [("2", 0.7), ("3", None), ("4", 1.0), ("c1", 0.5)]
    nums = Y.union_files([spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2.5,)], "x double")])
    assert dict(nums.dtypes)["x"] == "double"
