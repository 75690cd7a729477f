"""Rows-only operators checked against a plain-Python brute force on small inputs."""

import urllib.parse

from callsight.operators import reports as RP
from callsight.plans import catalog, fixtures as X

from .conftest import SMALL

LABELS = {"high": "[HIGH PRIORITY]", "medium": "[MEDIUM PRIORITY]", "low": "[LOW PRIORITY]"}


def plan_text(agent, themes, strengths, calls, date, footer):
    body = f"COACHING PLAN FOR {agent.upper()}\n{'=' * 60}\n\nSUMMARY\n   • Calls Analyzed: {calls}\n"
    body += f"   • Date Generated: {date}\n\n{'=' * 60}\n\nCOACHING THEMES\n"
    for idx, t in enumerate(themes, 1):
        body += f"\n{idx}. {t['theme'].upper()}\n   Priority: {LABELS.get(t['priority'], '[LOW]')}\n   \n"
        body += f"   Recommendation:\n   {t['recommendation']}\n"
        if t["examples"]:
            body += "   \n   Examples:\n"
            for ex in t["examples"][:2]:
                body += f"   • {ex}\n"
        body += "\n" + "-" * 60 + "\n"
    if strengths:
        body += "\nSTRENGTHS\n"
        for s in strengths:
            body += f"   • {s}\n"
        body += "\n" + "=" * 60 + "\n"
    return body + f"\n{footer}\n"


def test_plan_text_and_mailto_match_brute_force(spark):
    tr = catalog.theme_rows(spark, SMALL)
    ins = X.insights_from_theme_rows(tr)
    plans = RP.coaching_plan_text(tr, ins.select("agent", "strengths"), run_date="May 01, 2025", footer="F")
    got = {r.agent: r.plan_text for r in plans.collect()}
    links = {r.agent: r.mailto for r in RP.mailto_link(plans).collect()}
    for r in ins.collect():
        themes = [t.asDict() for t in r.coaching_themes]
        want = plan_text(r.agent, themes, list(r.strengths), 0, "May 01, 2025", "F")
        assert got[r.agent] == want
        q = urllib.parse.quote
        assert links[r.agent] == f"mailto:?subject={q('Coaching Plan - ' + r.agent)}&body={q(want)}"


def test_quote_special_characters(spark):
    df = spark.createDataFrame([("a", "x y~z*/é+&=\n'\"")], "agent string, plan_text string")
    got = RP.mailto_link(df).first().mailto
    assert got.endswith("&body=" + urllib.parse.quote("x y~z*/é+&=\n'\""))


def test_digest_sentiment_uses_python_rounding(spark):
    from callsight.operators import requests as R

    schema = "call_id string, agent string, turn_idx int, timestamp string, speaker string, message string, sentiment_score double"
    rows = [("c1", "A", 0, "t", "customer", "help", 0.125), ("c1", "A", 1, "t", "agent", "sure", 0.125),
            ("c2", "A", 0, "t", "customer", "hi", 2.675)]
    review = spark.createDataFrame(rows, schema)
    calls = review.select("agent", "call_id").distinct()
    got = {r.call_id: r.digest.split("\n")[0] for r in R.call_digest(review, calls).collect()}
    assert got == {"c1": f"Call 1: [Sentiment: {0.125:.2f}]", "c2": f"Call 2: [Sentiment: {2.675:.2f}]"}


def test_plan_of_an_agent_without_themes(spark):
    themes = spark.createDataFrame([("a", 0, "T", "high", ["e"], "r")], "agent string, theme_pos int, theme string, priority string, examples array<string>, recommendation string")
    strengths = spark.createDataFrame([("a", ["s"]), ("quiet", ["calm", "clear"]), ("none", None)], "agent string, strengths array<string>")
    plans = RP.coaching_plan_text(themes, strengths, run_date="May 01, 2025", footer="F")
    got = {r.agent: r.plan_text for r in plans.collect()}
    assert got["quiet"] == plan_text("quiet", [], ["calm", "clear"], 0, "May 01, 2025", "F")
    assert got["none"] == plan_text("none", [], [], 0, "May 01, 2025", "F")
    assert got["a"] == plan_text("a", [{"theme": "T", "priority": "high", "recommendation": "r", "examples": ["e"]}], ["s"], 0, "May 01, 2025", "F")
    assert {r.agent for r in RP.mailto_link(plans).collect()} == set(got)
