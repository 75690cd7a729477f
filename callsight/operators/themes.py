"""Coaching-theme lexicon and roll-ups (counts, priorities, 5C pillars, segments, rankings).

The working representation is the flat ``theme_rows`` table
``(agent, theme_pos, theme, priority, frequency, examples, recommendation)``:
one row per theme an agent received. Roll-ups are group-bys with map-side
partial aggregation; per-agent "first k" picks use ranking windows whose
partial WindowGroupLimit runs before the shuffle, so no agent's whole
theme list is ever gathered into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: the five pillars in order and
# their six themes each, in order.
# ---------------------------------------------------------------------------
PILLAR_THEMES = [
    ("Connection", [
        "Active Listening & Acknowledgment",
        "Empathy & Emotional Intelligence",
        "Building Rapport & Trust",
        "Professional Tone & Language",
        "Personalization & Context Awareness",
        "Emotional Regulation",
    ]),
    ("Clarity", [
        "Clear Communication & Articulation",
        "Process Adherence & Documentation",
        "Product Knowledge & Accuracy",
        "Jargon-Free Communication",
        "Step-by-Step Guidance",
        "Confirmation & Recap Skills",
    ]),
    ("Commitment", [
        "First Call Resolution",
        "Solution Offering & Alternatives",
        "Follow-up & Closure Quality",
        "Ownership Language Usage",
        "Timeline Setting & Commitments",
        "Accountability & Promises",
    ]),
    ("Challenge", [
        "Problem Diagnosis & Root Cause",
        "Handling Difficult Customers",
        "Escalation Judgment & Timing",
        "De-escalation Techniques",
        "Objection Handling",
        "Critical Thinking & Analysis",
    ]),
    ("Change", [
        "Response Time Management",
        "Proactive Communication",
        "Managing Customer Expectations",
        "Adaptability & Flexibility",
        "Feedback Responsiveness",
        "Continuous Improvement Mindset",
    ]),
]
# ---------------------------------------------------------------------------

PILLARS = [p for p, _ in PILLAR_THEMES]
DEFAULT_THEMES = [t for _, ts in PILLAR_THEMES for t in ts]


def theme_lexicon(spark: SparkSession) -> DataFrame:
    """``(theme_ord, pillar_ord, pillar, theme)`` — 30 fixed rows."""
    rows = []
    for p_ord, (pillar, themes) in enumerate(PILLAR_THEMES):
        for t in themes:
            rows.append((len(rows), p_ord, pillar, t))
    return spark.createDataFrame(rows, "theme_ord INT, pillar_ord INT, pillar STRING, theme STRING")


# ---------------------------------------------------------------------------
# Roll-ups over flat theme rows
# ---------------------------------------------------------------------------

from pyspark.sql import Column, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from callsight.functions.numbers import py_fixed  # noqa: E402
from callsight.functions.scalars import one_row, one_value  # noqa: E402
from callsight.functions.templates import fill  # noqa: E402
from callsight.operators.ordinal import with_global_ordinal  # noqa: E402

# Fixed values that must equal the reference: priority weights, segment
# bounds and labels, page size, fallback pillar and "none" texts.
PRIORITY_WEIGHTS = {"high": 3, "medium": 2}
OTHER_PRIORITY_WEIGHT = 1
SEGMENT_PRIORITY = "Priority Coaching"
SEGMENT_MODERATE = "Moderate Development"
SEGMENT_HIGH_PERFORMER = "High Performer"
AGENTS_PER_PAGE = 20
FALLBACK_PILLAR = "Connection"
NO_THEME = "N/A"
CONTEXT_AGENT_LINE = "\n{agent}: {n} themes\n"
CONTEXT_THEME_LINE = "  - {theme} ({priority}): {recommendation}...\n"
SUMMARY_THEME_ITEM = "{theme} ({n} agents)"
SUMMARY_THEME_SEPARATOR = ", "


def agents_of(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """All agents of the insights (agents with an empty theme list only exist in ``agents``)."""
    base = theme_rows.select("agent").distinct()
    if agents is None:
        return base
    return agents.select("agent").unionByName(base).distinct()


def _weight(priority: Column) -> Column:
    out = F.lit(OTHER_PRIORITY_WEIGHT)
    for p, w in reversed(list(PRIORITY_WEIGHTS.items())):
        out = F.when(priority == p, F.lit(w)).otherwise(out)
    return out


def pillar_match(theme: Column, pillar_ord: int, case_insensitive: bool) -> Column:
    """True if any lexicon theme of the pillar is a substring of ``theme``: plain ``contains`` tests of literals, which are code-generated."""
    text = F.lower(theme) if case_insensitive else theme
    words = [t.lower() if case_insensitive else t for t in PILLAR_THEMES[pillar_ord][1]]
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def first_pillar_ord(theme: Column) -> Column:
    """Ordinal of the first pillar whose lexicon (case-sensitive) hits the theme, else null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(PILLARS))):
        out = F.when(pillar_match(theme, i, False), F.lit(i)).otherwise(out)
    return out


def pillar_matches(theme_rows: DataFrame) -> DataFrame:
    """Per theme row: the first pillar whose lexicon hits the theme (case-sensitive, for scores)
    and the number of pillars it hits case-insensitively (for demand)."""
    th = F.col("theme")
    first = first_pillar_ord(th)
    names = _pillar_names()
    n_ci = sum(F.when(pillar_match(th, i, True), 1).otherwise(0) for i in range(len(PILLARS)))
    return theme_rows.select(
        "agent", "theme_pos", "theme", F.when(first.isNotNull(), names[first]).alias("first_pillar"), n_ci.cast("int").alias("n_pillars_ci")
    )


def _pillar_names() -> Column:
    return F.array(*[F.lit(p) for p in PILLARS])


def theme_table(theme_rows: DataFrame) -> DataFrame:
    """(agent, theme, priority, n): how often each theme stands for an agent at each priority.

    A mergeable table that every one-row summary is read off. Each reader uses
    ``n``, so all of them share one aggregation: Spark runs its exchange once
    and reuses it, and the theme rows are read once.
    """
    return theme_rows.groupBy("agent", "theme", "priority").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def priority_split(table: DataFrame) -> DataFrame:
    """``priority_dist`` off a theme table."""
    p = F.col("priority")
    return table.agg(*[F.coalesce(F.sum(F.when(p == v, F.col("n")).otherwise(0)), F.lit(0)).cast("bigint").alias(v) for v in ("high", "medium", "low")])


def agent_totals(table: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """One row off a theme table: agents, themes, and agents with four themes or more (priority_coaching) or two to three (moderate)."""
    per_agent = table.groupBy("agent").agg(F.sum("n").alias("n"))
    if agents is not None:
        per_agent = per_agent.unionByName(agents.select("agent", F.lit(0).cast("bigint").alias("n"))).groupBy("agent").agg(F.sum("n").alias("n"))
    n = F.col("n")
    return per_agent.agg(
        F.count(n).cast("bigint").alias("total_agents"),
        F.sum(n).cast("bigint").alias("total_themes"),
        F.sum(F.when(n >= 4, 1).otherwise(0)).cast("bigint").alias("priority_coaching"),
        F.sum(F.when((n >= 2) & (n < 4), 1).otherwise(0)).cast("bigint").alias("moderate"),
    )


def theme_counts(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Rows per theme and pct = rows / total agents × 100."""
    n_agents = one_value(agents_of(theme_rows, agents).agg(F.count(F.lit(1)).alias("n_agents")))
    counts = theme_rows.groupBy("theme").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.select("theme", "n", (F.col("n") * 100.0 / n_agents).alias("pct"))


def priority_dist(theme_rows: DataFrame) -> DataFrame:
    """One row: theme rows per priority (high, medium, low), zeros kept."""
    p = F.col("priority")
    return theme_rows.agg(
        *[F.sum(F.when(p == v, 1).otherwise(0)).cast("bigint").alias(v) for v in ("high", "medium", "low")]
    )


def _ranked_top(theme_rows: DataFrame, k: int) -> DataFrame:
    """One row: the ``k`` most frequent themes as an array sorted by (n desc, theme).

    The per-task top k runs before any exchange (TakeOrderedAndProject), so
    only k rows per task move; the final array holds at most k entries.
    """
    return _ranked(theme_rows.groupBy("theme").agg(F.count(F.lit(1)).cast("bigint").alias("n")), k)


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    top = counts.orderBy(F.desc("n"), F.asc("theme")).limit(k)  # top-k is the feature
    return top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg_n"), "theme", "n"))).alias("t"))


def top_themes(theme_rows: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent themes (ties by theme), with rank 1..k."""
    return _as_rows(_ranked_top(theme_rows, k))


def _as_rows(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.posexplode("t").alias("i", "x")).select(
        F.col("x.theme").alias("theme"), F.col("x.n").alias("n"), (F.col("i") + 1).cast("int").alias("rank")
    )


def theme_totals(table: DataFrame) -> DataFrame:
    """(theme, n) off a theme table."""
    return table.groupBy("theme").agg(F.sum("n").cast("bigint").alias("n"))


def top_of(table: DataFrame, k: int) -> DataFrame:
    """``top_themes`` off a theme table."""
    return _as_rows(_ranked(theme_totals(table), k))


def theme_bars(theme_rows: DataFrame, k: int = 8) -> DataFrame:
    """Top ``k`` themes with their bar length = n / max n × 100 (the max is the first entry)."""
    return _ranked_top(theme_rows, k).select(F.posexplode("t").alias("i", "x"), F.col("t")[0]["n"].alias("max_n")).select(
        F.col("x.theme").alias("theme"),
        F.col("x.n").alias("n"),
        (F.col("i") + 1).cast("int").alias("rank"),
        (F.col("x.n") * 100.0 / F.col("max_n")).alias("pct"),
    )


def pillar_demand(theme_rows: DataFrame) -> DataFrame:
    """Per pillar: theme rows matching it case-insensitively (a row may count for several pillars)."""
    # Each different theme is tested once; its rows are counted before.
    return _demand(theme_rows.groupBy("theme").agg(F.count(F.lit(1)).alias("n")))


def _demand(counts: DataFrame) -> DataFrame:
    th = F.col("theme")
    wide = counts.agg(
        *[F.coalesce(F.sum(F.when(pillar_match(th, i, True), F.col("n")).otherwise(0)), F.lit(0)).cast("bigint").alias(f"p{i}") for i in range(len(PILLARS))]
    )
    long = wide.select(
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("pillar_ord"), F.lit(p).alias("pillar"), F.col(f"p{i}").alias("n")) for i, p in enumerate(PILLARS)])
        )
    )
    return long.where(F.col("n") > 0)


def top_pillar(theme_rows: DataFrame) -> DataFrame:
    """One row: the pillar with the largest demand (ties by pillar order), else the fallback with 0."""
    return _top_demand(pillar_demand(theme_rows))


def _top_demand(d: DataFrame) -> DataFrame:
    best = d.orderBy(F.desc("n"), F.asc("pillar_ord")).limit(1)
    fallback = d.sparkSession.createDataFrame([(99, FALLBACK_PILLAR, 0)], "pillar_ord INT, pillar STRING, n BIGINT")
    both = best.unionByName(fallback)
    return both.orderBy(F.asc("pillar_ord")).limit(1).select(F.col("pillar").alias("top_pillar"), F.col("n").alias("top_pillar_n"))


def pillar_scores_wide(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Per agent: weighted score per pillar (first case-sensitive pillar only), zero-filled."""
    # Equal themes of an agent are summed up before the lexicon tests.
    summed = theme_rows.groupBy("agent", "theme").agg(F.sum(_weight(F.col("priority"))).alias("w"))
    scored = summed.select("agent", first_pillar_ord(F.col("theme")).alias("po"), "w")
    wide = scored.groupBy("agent").agg(
        *[F.sum(F.when(F.col("po") == i, F.col("w")).otherwise(0)).cast("bigint").alias(f"s{i}") for i in range(len(PILLARS))]
    )
    if agents is None:
        return wide
    return agents_of(theme_rows, agents).join(wide, "agent", "left").fillna(0, [f"s{i}" for i in range(len(PILLARS))])


def pillar_scores(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Long form: (agent, pillar_ord, pillar, score) for every agent and all five pillars."""
    wide = pillar_scores_wide(theme_rows, agents)
    return wide.select(
        "agent",
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("pillar_ord"), F.lit(p).alias("pillar"), F.col(f"s{i}").alias("score")) for i, p in enumerate(PILLARS)])
        ),
    )


def pillar_agent_counts(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Per pillar: agents with a score above zero."""
    wide = pillar_scores_wide(theme_rows, agents)
    one = wide.agg(*[F.sum(F.when(F.col(f"s{i}") > 0, 1).otherwise(0)).cast("bigint").alias(f"c{i}") for i in range(len(PILLARS))])
    return one.select(
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("pillar_ord"), F.lit(p).alias("pillar"), F.col(f"c{i}").alias("n_agents")) for i, p in enumerate(PILLARS)])
        )
    )


def pillar_top_agents(theme_rows: DataFrame, k: int = 5, agents: DataFrame | None = None) -> DataFrame:
    """Per pillar the top ``k`` agents by score (ties by agent), then zero scores dropped.

    Adds ``pct`` = score / best kept score × 100. The ranking window keeps at
    most k rows per pillar per task before the shuffle.
    """
    s = pillar_scores(theme_rows, agents)
    w = Window.partitionBy("pillar_ord").orderBy(F.desc("score"), F.asc("agent"))
    top = s.select("pillar_ord", "pillar", "agent", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    kept = top.where(F.col("score") > 0)
    return kept.select(
        "pillar_ord",
        "pillar",
        "agent",
        "score",
        F.col("rank").cast("int").alias("rank"),
        (F.col("score") * 100.0 / F.max("score").over(Window.partitionBy("pillar_ord"))).alias("pct"),
    )


def pillar_cards(theme_rows: DataFrame, k: int = 5, agents: DataFrame | None = None) -> DataFrame:
    """Cards for the top agents per pillar: first two relevant themes joined by ', ' plus ' +n'.

    A theme is relevant to every pillar whose lexicon (case-sensitive) hits it.
    """
    top = pillar_top_agents(theme_rows, k, agents)  # ≤ k × 5 rows
    hits = theme_rows.select(
        "agent",
        "theme_pos",
        "theme",
        F.explode(
            F.filter(
                F.array(*[F.when(pillar_match(F.col("theme"), i, False), F.lit(i)) for i in range(len(PILLARS))]),
                lambda x: x.isNotNull(),
            )
        ).alias("pillar_ord"),
    )
    rel = hits.join(F.broadcast(top.select("pillar_ord", "agent")), ["pillar_ord", "agent"], "left_semi")  # ≤ 25 keys
    # Count with partial aggregation; the first two come from a ranking filter,
    # which Spark limits per task before the shuffle. No group is gathered whole.
    counts = rel.groupBy("pillar_ord", "agent").agg(F.count(F.lit(1)).alias("n_rel"))
    w = Window.partitionBy("pillar_ord", "agent").orderBy("theme_pos", "theme")
    firsts = (
        rel.select("pillar_ord", "agent", "theme_pos", "theme", F.row_number().over(w).alias("rn"))
        .where(F.col("rn") <= 2)
        .groupBy("pillar_ord", "agent")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "theme"))).alias("first2"))
    )
    agg = counts.join(firsts, ["pillar_ord", "agent"])
    text = F.concat(
        F.array_join(F.transform("first2", lambda x: x["theme"]), ", "),
        F.when(F.col("n_rel") > 2, F.concat(F.lit(" +"), (F.col("n_rel") - 2).cast("string"))).otherwise(F.lit("")),
    )
    out = top.join(agg.select("pillar_ord", "agent", text.alias("themes_text")), ["pillar_ord", "agent"], "left")
    return out.select("pillar", "agent", "rank", "score", "pct", F.coalesce("themes_text", F.lit("")).alias("themes_text"))


def agent_theme_counts(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Per agent: number of themes and of high / medium ones (0 for agents without themes)."""
    c = theme_rows.groupBy("agent").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_themes"),
        F.sum(F.when(F.col("priority") == "high", 1).otherwise(0)).cast("bigint").alias("n_high"),
        F.sum(F.when(F.col("priority") == "medium", 1).otherwise(0)).cast("bigint").alias("n_medium"),
    )
    if agents is None:
        return c
    return agents_of(theme_rows, agents).join(c, "agent", "left").fillna(0, ["n_themes", "n_high", "n_medium"])


def _segment(n: Column) -> Column:
    return F.when(n >= 4, F.lit(SEGMENT_PRIORITY)).when(n >= 2, F.lit(SEGMENT_MODERATE)).otherwise(F.lit(SEGMENT_HIGH_PERFORMER))


def agent_segments(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Agents per segment (≥4 themes, 2-3, 0-1); all three segments present."""
    c = agent_theme_counts(theme_rows, agents)
    one = c.agg(
        *[
            F.sum(F.when(_segment(F.col("n_themes")) == lbl, 1).otherwise(0)).cast("bigint").alias(f"g{i}")
            for i, lbl in enumerate((SEGMENT_HIGH_PERFORMER, SEGMENT_MODERATE, SEGMENT_PRIORITY))
        ]
    )
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(lbl).alias("segment"), F.col(f"g{i}").alias("n_agents"))
                    for i, lbl in enumerate((SEGMENT_HIGH_PERFORMER, SEGMENT_MODERATE, SEGMENT_PRIORITY))
                ]
            )
        )
    )


def agent_ranking(theme_rows: DataFrame, agents: DataFrame | None = None, per_page: int = AGENTS_PER_PAGE) -> DataFrame:
    """Agents by (high, medium) desc, ties by agent; global rank, page and page count.

    The rank is a distributed ordinal (no single-task window over all agents).
    """
    c = agent_theme_counts(theme_rows, agents)
    ranked = with_global_ordinal(c, [F.desc("n_high"), F.desc("n_medium"), F.asc("agent")], "rank")
    total = one_value(c.agg(F.count(F.lit(1)).alias("_n")))
    return ranked.select(
        "agent",
        "n_high",
        "n_medium",
        "rank",
        (F.floor((F.col("rank") - 1) / per_page) + 1).cast("bigint").alias("page"),
        F.ceil(total / per_page).cast("bigint").alias("total_pages"),
    )


def first_theme(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Per agent: the first theme in list order and its priority ('N/A'/'low' if none)."""
    f = theme_rows.groupBy("agent").agg(F.min_by(F.struct("theme", "priority"), F.col("theme_pos")).alias("f"))
    base = agents_of(theme_rows, agents)
    return base.join(f, "agent", "left").select(
        "agent",
        F.coalesce(F.col("f.theme"), F.lit(NO_THEME)).alias("top_theme"),
        F.coalesce(F.col("f.priority"), F.lit("low")).alias("top_priority"),
    )


def agent_summary_rows(theme_rows: DataFrame, agents: DataFrame | None = None, per_page: int = AGENTS_PER_PAGE) -> DataFrame:
    """Ranking rows with calls, first theme, priority, page and the agent's initial.

    Counts and the first theme come from one grouping by agent, which is then
    ranked; ``agents(agent, calls_analyzed)`` adds the agents without themes and
    the calls that went to review.
    """
    rows = theme_rows.groupBy("agent").agg(
        F.sum(F.when(F.col("priority") == "high", 1).otherwise(0)).cast("bigint").alias("n_high"),
        F.sum(F.when(F.col("priority") == "medium", 1).otherwise(0)).cast("bigint").alias("n_medium"),
        F.min_by(F.struct("theme", "priority"), F.col("theme_pos")).alias("f"),
    )
    if agents is not None:
        named = agents.select("agent", *(["calls_analyzed"] if "calls_analyzed" in agents.columns else []))
        rows = rows.join(named, "agent", "full_outer").fillna(0, ["n_high", "n_medium"])
    calls = F.col("calls_analyzed") if "calls_analyzed" in rows.columns else F.lit(None)
    rows = rows.withColumn("calls", F.coalesce(calls.cast("bigint"), F.lit(0).cast("bigint")))
    ranked = with_global_ordinal(rows, [F.desc("n_high"), F.desc("n_medium"), F.asc("agent")], "rank")
    return ranked.select(
        "agent",
        "rank",
        (F.floor((F.col("rank") - 1) / per_page) + 1).cast("bigint").alias("page"),
        "calls",
        F.coalesce("f.theme", F.lit(NO_THEME)).alias("top_theme"),
        F.coalesce("f.priority", F.lit("low")).alias("top_priority"),
        F.upper(F.substring("agent", 1, 1)).alias("initial"),
    )


def _prio_rank(p: Column) -> Column:
    return F.when(p == "high", 1).when(p == "medium", 2).otherwise(3)


def agent_needs(theme_rows: DataFrame, k: int = 3) -> DataFrame:
    """Per agent up to ``k`` themes ordered high, medium, other, then list order."""
    w = Window.partitionBy("agent").orderBy(_prio_rank(F.col("priority")), F.col("theme_pos"))
    return (
        theme_rows.select("agent", "theme_pos", "theme", "priority", "recommendation", F.row_number().over(w).alias("need_rank"))
        .where(F.col("need_rank") <= k)
        .withColumn("need_rank", F.col("need_rank").cast("int"))
    )


def _first_agents(theme_rows: DataFrame, n: int | None) -> DataFrame:
    """The rows of all agents, or of the first ``n`` in agent order (a top-n report)."""
    if n is None:
        return theme_rows
    return theme_rows.join(agents_of(theme_rows).orderBy("agent").limit(n), "agent", "left_semi")


def _cut(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.substring(c, 1, chars)


def profile_themes(theme_rows: DataFrame, n_agents: int | None = None, n_themes: int = 3, rec_chars: int | None = None) -> DataFrame:
    """Per agent its first ``n_themes`` themes; upper priority. ``n_agents`` and ``rec_chars`` cut a report to size."""
    rows = _first_agents(theme_rows, n_agents).where(F.col("theme_pos") < n_themes)
    return rows.select(
        "agent",
        "theme_pos",
        "theme",
        F.upper("priority").alias("priority_label"),
        _cut(F.col("recommendation"), rec_chars).alias("recommendation"),
    )


def context_block(theme_rows: DataFrame, n_agents: int | None = None, n_themes: int = 2, rec_chars: int | None = None) -> DataFrame:
    """Per agent a text block with its theme count and first ``n_themes`` themes."""
    g = _first_agents(theme_rows, n_agents).groupBy("agent").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_themes"),
        F.array_sort(
            F.collect_list(F.when(F.col("theme_pos") < n_themes, F.struct("theme_pos", "theme", "priority", "recommendation")))
        ).alias("firsts"),
    )
    line = lambda x: fill(
        CONTEXT_THEME_LINE, {"theme": x["theme"], "priority": x["priority"], "recommendation": _cut(x["recommendation"], rec_chars)}
    )
    text = F.concat(
        fill(CONTEXT_AGENT_LINE, {"agent": F.col("agent"), "n": F.col("n_themes").cast("string")}),
        F.array_join(F.transform("firsts", line), ""),
    )
    return g.select("agent", "n_themes", text.alias("block"))


def theme_card_text(theme_rows: DataFrame) -> DataFrame:
    """Per theme row: first two examples joined by ' | ', frequency and priority."""
    return theme_rows.select(
        "agent",
        "theme_pos",
        "theme",
        "priority",
        "frequency",
        F.array_join(F.slice(F.coalesce("examples", F.array().cast("array<string>")), 1, 2), " | ").alias("examples_text"),
    )


def call_totals(turns: DataFrame) -> DataFrame:
    """One row: different calls, different agents (null left out) and the mean sentiment over turns.

    Turns are summed up to (agent, call) once; each such row then counts once
    for its call and once for its agent.
    """
    s = F.col("sentiment_score")
    score = F.when(~F.isnan(s), s)
    per_call = turns.groupBy("agent", "call_id").agg(F.sum(score).alias("s"), F.count(score).alias("n"))
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    roles = F.array(
        F.struct(F.lit("call").alias("role"), F.col("call_id").cast("string").alias("name"), F.col("s").alias("s"), F.col("n").alias("n")),
        F.struct(F.lit("agent").alias("role"), F.col("agent").alias("name"), nothing.alias("s"), zero.alias("n")),
    )
    each = per_call.select(F.inline(roles)).groupBy("role", "name").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    named = lambda role: F.count(F.when(F.col("role") == role, F.col("name"))).cast("bigint")
    return each.agg(named("call").alias("total_calls"), named("agent").alias("total_agents"), F.try_divide(F.sum("s"), F.sum("n")).alias("avg_sentiment"))


def report_header(turns: DataFrame, theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """One row: distinct calls, agents in the insights, total themes, mean sentiment (turn-weighted)."""
    t = call_totals(turns).select("total_calls", F.col("avg_sentiment").alias("_avg"))
    row = t.select("*", one_row(agent_totals(theme_table(theme_rows), agents)).alias("_a"))
    return row.select(
        "total_calls",
        F.col("_a.total_agents").alias("total_agents"),
        F.coalesce(F.col("_a.total_themes"), F.lit(0)).cast("bigint").alias("total_themes"),
        F.col("_avg").alias("avg_sentiment"),
        # The text is formatted from the unrounded mean, with Python's rounding.
        F.when(F.col("_avg") > 0, py_fixed(F.col("_avg"), 2)).otherwise(F.lit(NO_THEME)).alias("avg_sentiment_text"),
    )


def exec_summary(turns: DataFrame, theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """One row: header numbers, priority split, top 3 themes, top pillar, segment counts.

    The turns are read once (``call_totals``) and the theme rows once (``theme_table``).
    """
    table = theme_table(theme_rows)
    h = call_totals(turns).select("total_calls", "avg_sentiment")
    p = priority_split(table)
    top3 = top_of(table, 3).agg(
        F.array_sort(F.collect_list(F.struct("rank", "theme", "n"))).alias("t")  # ≤ 3 rows
    ).select(
        F.array_join(
            F.transform("t", lambda x: fill(SUMMARY_THEME_ITEM, {"theme": x["theme"], "n": x["n"].cast("string")})), SUMMARY_THEME_SEPARATOR
        ).alias("text"),
        F.coalesce(F.col("t")[0]["theme"], F.lit("")).alias("focus"),
    )
    tp = _top_demand(_demand(theme_totals(table)))
    seg = agent_totals(table, agents)
    # h is the one-row base; each other one-row table is attached once as a struct column.
    wide = h.select(
        "*", one_row(p).alias("_p"), one_row(tp).alias("_tp"), one_row(seg).alias("_seg"), one_row(top3).alias("_top3")
    )
    return wide.select(
        "total_calls",
        F.col("_seg.total_agents").alias("total_agents"),
        "avg_sentiment",
        F.col("_p.high").alias("high_themes"),
        F.col("_p.medium").alias("medium_themes"),
        F.col("_p.low").alias("low_themes"),
        F.col("_top3.text").alias("top_themes_text"),
        F.col("_top3.focus").alias("focus_theme"),
        F.col("_tp.top_pillar").alias("top_pillar"),
        F.col("_tp.top_pillar_n").alias("top_pillar_n"),
        (F.col("_seg.total_agents") - _none(F.col("_seg.priority_coaching")) - _none(F.col("_seg.moderate"))).alias("high_performers"),
        _none(F.col("_seg.moderate")).alias("moderate"),
        _none(F.col("_seg.priority_coaching")).alias("priority_coaching"),
    )


def _none(count: Column) -> Column:
    """A sum over no rows is 0."""
    return F.coalesce(count, F.lit(0)).cast("bigint")
