"""Report texts built per agent (or as one summary row) with column expressions.

Per-agent texts only gather that agent's themes, which are bounded by one
model response; summary texts gather top-k rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.functions.numbers import py_fixed
from callsight.functions.scalars import one_row, one_value
from callsight.functions.templates import fill
from callsight.operators import themes as H

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's texts. Placeholders in braces
# are filled per agent (or per theme); everything else is literal text.
# ---------------------------------------------------------------------------
RULE = "=" * 60
THIN_RULE = "-" * 60
PRIORITY_LABELS = {"high": "[HIGH PRIORITY]", "medium": "[MEDIUM PRIORITY]", "low": "[LOW PRIORITY]"}
OTHER_PRIORITY_LABEL = "[LOW]"
PLAN_EXAMPLES = 2
PLAN_HEADER = (
    "COACHING PLAN FOR {agent}\n"
    "{rule}\n"
    "\n"
    "SUMMARY\n"
    "   • Calls Analyzed: {calls}\n"
    "   • Date Generated: {date}\n"
    "\n"
    "{rule}\n"
    "\n"
    "COACHING THEMES\n"
)
PLAN_THEME = (
    "\n"
    "{n}. {theme}\n"
    "   Priority: {label}\n"
    "   \n"
    "   Recommendation:\n"
    "   {recommendation}\n"
)
PLAN_EXAMPLES_HEADER = "   \n   Examples:\n"
PLAN_BULLET = "   • {item}\n"
PLAN_THEME_END = "\n{thin_rule}\n"
PLAN_STRENGTHS_HEADER = "\nSTRENGTHS\n"
PLAN_STRENGTHS_END = "\n{rule}\n"
PLAN_FOOTER = "\n{footer}\n"
MAIL_SUBJECT = "Coaching Plan - {agent}"
MAIL_LINK = "mailto:?subject={subject}&body={body}"
PROFILE_THEMES = 3
PROFILE_PILLAR_LINE = "{pillar}: {score} coaching points"
PROFILE_THEME = "{n}. {theme}\nPriority Level: {priority}"
PROFILE_RECOMMENDATION = "\n{recommendation}..."
CONTEXT_TEMPLATE = (
    "\n"
    "COACHING ANALYTICS CONTEXT:\n"
    "\n"
    "Dataset Overview:\n"
    "- Total Agents Analyzed: {agents}\n"
    "- Total Calls: {calls}\n"
    "- Average Sentiment: {sentiment}/5.0\n"
    "\n"
    "Theme Distribution:\n"
    "{themes}"
    "\n"
    "Priority Breakdown:\n"
    "- High Priority: {high} themes requiring immediate attention\n"
    "- Medium Priority: {medium} themes\n"
    "- Low Priority: {low} themes\n"
    "\n"
    "Available Tables:\n"
    "- transcripts: call_id, agent, speaker, message, sentiment_score, timestamp\n"
    "- coaching_cache: agent, theme, priority, frequency, recommendation, processed_at\n"
    "\n"
    "You can answer questions about:\n"
    "- Agent performance comparisons\n"
    "- Theme correlations and patterns\n"
    "- Sentiment analysis by agent or theme\n"
    "- Call volume and engagement metrics\n"
)
SUMMARY_TEMPLATE = (
    "Executive Summary\n"
    "\n"
    "Analysis Overview\n"
    "- {agents} agents analyzed across {calls} calls\n"
    "- Report generated: {date}\n"
    "- Average sentiment score: {sentiment}/5.0\n"
    "\n"
    "Critical Findings\n"
    "- {high} agents require immediate coaching intervention (high-priority themes)\n"
    "{needs}"
    "- {pillar} pillar shows highest coaching demand ({demand} agents affected)\n"
    "\n"
    "Agent Segmentation\n"
    "- High Performers: {performers} agents (0-1 coaching themes)\n"
    "- Moderate Development: {moderate} agents (2-3 themes)\n"
    "- Priority Coaching: {priority} agents (4+ themes)\n"
    "\n"
    "Recommended Actions\n"
    "- Immediate 1-on-1 coaching sessions for {high} high-priority agents\n"
    "- Launch targeted {pillar} training program (impacts {demand} agents)\n"
    "{workshop}"
    "- Establish monthly coaching review cycle for moderate-need agents\n"
)
SUMMARY_NEEDS = "- Top coaching needs: {themes}\n"
SUMMARY_WORKSHOP = "- Conduct focused workshop on {theme} (most common challenge)\n"
CONTEXT_THEME_LINE = "- #{rank} Theme: {theme} ({n} agents, {pct}%)\n"
MISSING_SENTIMENT_TEXT = "nan"
# ---------------------------------------------------------------------------
DEFAULT_FOOTER = "Generated by the coaching analytics job"


def _nested(theme_rows: DataFrame) -> DataFrame:
    """Per agent the ordered theme list (bounded by one response)."""
    return theme_rows.groupBy("agent").agg(
        F.array_sort(F.collect_list(F.struct("theme_pos", "theme", "priority", "examples", "recommendation"))).alias("t")
    )


def _label(p: Column) -> Column:
    out = F.lit(OTHER_PRIORITY_LABEL)
    for k, v in reversed(list(PRIORITY_LABELS.items())):
        out = F.when(p == k, F.lit(v)).otherwise(out)
    return out


def coaching_plan_text(
    theme_rows: DataFrame,
    strengths: DataFrame | None = None,
    calls: DataFrame | None = None,
    run_date: str = "January 01, 2025",
    footer: str = DEFAULT_FOOTER,
) -> DataFrame:
    """Per agent: the plain-text coaching plan (numbered themes, priority label, advice, two examples, strengths)."""
    n = _nested(theme_rows)
    if strengths is not None:  # agents with strengths alone have a plan too, without a theme
        n = n.join(strengths.select("agent", "strengths"), "agent", "full_outer")
        n = n.withColumn("t", F.coalesce("t", F.array().cast(n.schema["t"].dataType)))
    else:
        n = n.withColumn("strengths", F.array().cast("array<string>"))
    if calls is not None:
        n = n.join(calls.select("agent", F.col("calls_analyzed").cast("bigint")), "agent", "left")
    else:
        n = n.withColumn("calls_analyzed", F.lit(0).cast("bigint"))
    bullets = lambda items: F.array_join(F.transform(items, lambda e: fill(PLAN_BULLET, {"item": e})), "")
    theme_block = F.transform(
        "t",
        lambda x, i: F.concat(
            fill(
                PLAN_THEME,
                {"n": (i + 1).cast("string"), "theme": F.upper(x["theme"]), "label": _label(x["priority"]), "recommendation": x["recommendation"]},
            ),
            F.when(
                F.size(x["examples"]) > 0, F.concat(F.lit(PLAN_EXAMPLES_HEADER), bullets(F.slice(x["examples"], 1, PLAN_EXAMPLES)))
            ).otherwise(F.lit("")),
            fill(PLAN_THEME_END, {"thin_rule": F.lit(THIN_RULE)}),
        ),
    )
    strengths_block = F.when(
        F.size(F.coalesce("strengths", F.array().cast("array<string>"))) > 0,
        F.concat(F.lit(PLAN_STRENGTHS_HEADER), bullets(F.col("strengths")), fill(PLAN_STRENGTHS_END, {"rule": F.lit(RULE)})),
    ).otherwise(F.lit(""))
    header = fill(
        PLAN_HEADER,
        {
            "agent": F.upper("agent"),
            "rule": F.lit(RULE),
            "calls": F.coalesce(F.col("calls_analyzed"), F.lit(0)).cast("string"),
            "date": F.lit(run_date),
        },
    )
    text = F.concat(header, F.array_join(theme_block, ""), strengths_block, fill(PLAN_FOOTER, {"footer": F.lit(footer)}))
    return n.select("agent", text.alias("plan_text"))


def _quote(c: Column) -> Column:
    """Percent-encoding with the standard quoting rules (unreserved and '/' kept, space → %20)."""
    e = F.url_encode(c)
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("%2F"), F.lit("/"))


def mailto_link(plans: DataFrame) -> DataFrame:
    """Per agent: ``mailto:?subject=…&body=…`` with the plan text percent-encoded."""
    subject = fill(MAIL_SUBJECT, {"agent": F.col("agent")})
    return plans.select("agent", fill(MAIL_LINK, {"subject": _quote(subject), "body": _quote(F.col("plan_text"))}).alias("mailto"))


def agent_profile(theme_rows: DataFrame, n_agents: int | None = None, rec_chars: int | None = None) -> DataFrame:
    """Per agent: nonzero pillar scores as text and its first three themes. ``n_agents`` and ``rec_chars`` cut a report to size."""
    rows = H._first_agents(theme_rows, n_agents)
    wide = H.pillar_scores_wide(rows)
    framework = F.array_join(
        F.filter(
            F.array(
                *[
                    F.when(F.col(f"s{i}") > 0, fill(PROFILE_PILLAR_LINE, {"pillar": F.lit(p), "score": F.col(f"s{i}").cast("string")}))
                    for i, p in enumerate(H.PILLARS)
                ]
            ),
            lambda x: x.isNotNull(),
        ),
        "\n",
    )
    firsts = rows.where(F.col("theme_pos") < PROFILE_THEMES).groupBy("agent").agg(
        F.array_sort(F.collect_list(F.struct("theme_pos", "theme", "priority", "recommendation"))).alias("t")  # ≤ 3
    )
    themes_text = F.array_join(
        F.transform(
            "t",
            lambda x, i: F.concat(
                fill(PROFILE_THEME, {"n": (i + 1).cast("string"), "theme": x["theme"], "priority": F.upper(x["priority"])}),
                F.when(
                    F.length(x["recommendation"]) > 0,
                    fill(PROFILE_RECOMMENDATION, {"recommendation": H._cut(x["recommendation"], rec_chars)}),
                ).otherwise(F.lit("")),
            ),
        ),
        "\n",
    )
    return wide.join(firsts, "agent", "left").select("agent", framework.alias("framework_text"), themes_text.alias("themes_text"))


def analytics_context(turns: DataFrame, theme_rows: DataFrame) -> DataFrame:
    """One row: agents, calls, mean sentiment, top 3 themes with share, priority split, and the text block."""
    # The turns are read once; t is the one-row base, and the other one-row tables, off one theme table, are scalar subqueries.
    table = H.theme_table(theme_rows)
    t = H.call_totals(turns).select("total_calls", "avg_sentiment")
    a, p = one_row(H.agent_totals(table)), one_row(H.priority_split(table))
    top3 = one_value(H.top_of(table, 3).agg(F.array_sort(F.collect_list(F.struct("rank", "theme", "n"))).alias("top3")))  # 3 rows
    attached = t.select("total_calls", "avg_sentiment", a.alias("_a"), p.alias("_p"), top3.alias("top3"))
    row = attached.select(
        "total_calls", "avg_sentiment", F.col("_a.total_agents").alias("total_agents"), F.col("_p.high").alias("high"),
        F.col("_p.medium").alias("medium"), F.col("_p.low").alias("low"), "top3",
    )
    dist = F.array_join(
        F.transform(
            "top3",
            lambda x: fill(
                CONTEXT_THEME_LINE,
                {
                    "rank": x["rank"].cast("string"),
                    "theme": x["theme"],
                    "n": x["n"].cast("string"),
                    "pct": py_fixed(x["n"] * 100.0 / F.col("total_agents"), 1),
                },
            ),
        ),
        "",
    )
    text = fill(
        CONTEXT_TEMPLATE,
        {
            "agents": F.col("total_agents").cast("string"),
            "calls": F.format_number(F.col("total_calls"), 0),
            "sentiment": F.when(F.col("avg_sentiment").isNull(), F.lit(MISSING_SENTIMENT_TEXT)).otherwise(
                py_fixed(F.col("avg_sentiment"), 2)
            ),
            "themes": dist,
            "high": F.col("high").cast("string"),
            "medium": F.col("medium").cast("string"),
            "low": F.col("low").cast("string"),
        },
    )
    return row.select(
        "total_agents", "total_calls", "avg_sentiment",
        F.col("high").alias("high_themes"), F.col("medium").alias("medium_themes"), F.col("low").alias("low_themes"),
        text.alias("context_text"),
    )


def exec_summary_text(turns: DataFrame, theme_rows: DataFrame, agents: DataFrame | None = None, run_date: str = "January 01, 2025") -> DataFrame:
    """One row: the executive summary as plain text."""
    s = H.exec_summary(turns, theme_rows, agents)
    some = F.col("focus_theme") != ""
    text = lambda c: F.col(c).cast("string")
    values = {
        "agents": text("total_agents"),
        "calls": F.format_number(F.col("total_calls"), 0),
        "date": F.lit(run_date),
        "sentiment": F.when(F.col("avg_sentiment").isNull(), F.lit(MISSING_SENTIMENT_TEXT)).otherwise(py_fixed(F.col("avg_sentiment"), 2)),
        "high": text("high_themes"),
        "needs": F.when(some, fill(SUMMARY_NEEDS, {"themes": F.col("top_themes_text")})).otherwise(F.lit("")),
        "pillar": F.col("top_pillar"),
        "demand": text("top_pillar_n"),
        "performers": text("high_performers"),
        "moderate": text("moderate"),
        "priority": text("priority_coaching"),
        "workshop": F.when(some, fill(SUMMARY_WORKSHOP, {"theme": F.col("focus_theme")})).otherwise(F.lit("")),
    }
    return s.select(fill(SUMMARY_TEMPLATE, values).alias("summary_text"))


def cache_count(cache: DataFrame) -> DataFrame:
    """One row: cached theme rows and whether the cache is usable."""
    return cache.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select("n_rows", (F.col("n_rows") > 0).alias("has_coaching"))
