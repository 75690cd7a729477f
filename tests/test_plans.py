"""Physical plan shape: no Python evaluation, no cartesian products, top-k limited before shuffles."""

import re

import pytest

from callsight.plans import catalog

from .conftest import MEDIUM


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["parse_turns", "agent_stats", "worst_calls", "first_messages", "pillar_top_agents", "validated_themes"])
def test_no_python_and_no_cartesian(spark, name):
    p = _plan(catalog.QUERIES[name](spark, MEDIUM))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["worst_calls", "first_messages", "pillar_top_agents", "pillar_cards", "agent_needs", "call_digest"])
def test_topk_is_limited_before_the_shuffle(spark, name):
    p = _plan(catalog.QUERIES[name](spark, MEDIUM))
    assert re.search(r"WindowGroupLimit .*Partial", p), p


def test_ranking_has_no_single_partition_window_over_rows(spark):
    # The only SinglePartition exchange is the per-partition offset table (bounded by the partition count).
    df = catalog.QUERIES["agent_ranking"](spark, MEDIUM)
    p = _plan(df)
    assert p.count("Exchange SinglePartition") <= 2


def test_scan_prunes_columns(spark):
    p = _plan(catalog.QUERIES["pillar_scores"](spark, MEDIUM))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    assert scans and all("text" not in s for s in scans)  # documents.text is never read for theme roll-ups


FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def test_no_query_has_python_cartesian_or_nested_loop_operators(spark):
    from .conftest import SMALL

    bad = {}
    for name, fn in sorted(catalog.QUERIES.items()):
        p = _plan(fn(spark, SMALL))
        hits = [op for op in FORBIDDEN if op in p]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_scalar_values_are_planned_once(spark):
    # Each one-row table is attached once as a column: a long expression over a
    # scalar value must not multiply its subquery (one per reference otherwise).
    from .conftest import SMALL

    worst = {}
    for name, fn in sorted(catalog.QUERIES.items()):
        n = len(set(re.findall(r"Subquery subquery#(\d+)", _plan(fn(spark, SMALL)))))
        worst[name] = n
    assert max(worst.values()) <= 6, sorted(worst.items(), key=lambda kv: -kv[1])[:5]


COUNTS = ["total_calls", "total_agents", "volume_counts", "sentiment_stats", "flow_stats", "speaker_counts", "kpi_row", "call_sentiment", "agent_call_counts",
          "report_header", "exec_summary", "exec_summary_text", "analytics_context", "session_metadata", "answer_questions"]


@pytest.mark.parametrize("name", COUNTS)
def test_counts_do_not_redact(spark, name):
    p = _plan(catalog.QUERIES[name](spark, MEDIUM))
    assert "REDACTED" not in p and "Expand" not in p


@pytest.mark.parametrize("name, most", [("validate_insights", 1), ("agent_summary_rows", 3), ("pillar_demand", 1), ("merge_insights", 2)])
def test_scans(spark, name, most):
    assert _plan(catalog.QUERIES[name](spark, MEDIUM)).count("FileScan") <= most


def test_answers_read_no_turn_twice_in_one_aggregate(spark):
    assert "Expand" not in _plan(catalog.QUERIES["answer_questions"](spark, MEDIUM))


def _scans_run(df) -> int:
    """File scans of the plan that ran: a reused exchange is none."""
    df.collect()
    plan = _plan(df)
    return sum(x.split("== Initial Plan ==")[0].count("FileScan") for x in plan.split("== Final Plan ==")[1:])


@pytest.mark.parametrize("name, most", [("report_header", 2), ("exec_summary", 2), ("exec_summary_text", 2), ("analytics_context", 2), ("question_intent", 2), ("answer_questions", 4)])
def test_summaries_read_each_table_once(spark, name, most):
    # answer_questions: turns, theme table, needs texts, and the questions themselves (made from the theme rows here).
    assert _scans_run(catalog.QUERIES[name](spark, MEDIUM)) <= most


def test_heads_are_one_scan_without_a_shuffle(spark):
    from callsight.operators import transcripts as P

    p = _plan(P.call_heads(catalog.calls(spark, MEDIUM)))
    calls = _plan(catalog.calls(spark, MEDIUM))
    assert p.count("FileScan") == 1 and "Window" not in p and p.count("Exchange") == calls.count("Exchange")


@pytest.mark.parametrize("name", ["call_digest", "call_digest_wide", "agent_prompt", "agent_prompt_wide"])
def test_digests_read_heads_alone(spark, name):
    p = _plan(catalog.QUERIES[name](spark, MEDIUM))
    assert "transcript" not in p and "regexp" not in p.lower() and "heads-" in p
