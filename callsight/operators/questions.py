"""Canned questions: keyword routing and SQL-backed answers, as DataFrame joins.

``questions(question_id, question)`` is routed row by row with ordered
``contains`` tests. Agent mentions are found with an equi-join on q-grams:
each lower-cased name stands under its rarest q-gram (by counts over all
names), a question offers each of its different q-grams once, and a pair that
meets is verified. That is the same result as testing every (question, agent)
pair, without emitting all pairs; a question gives no more rows than it has
q-grams, whatever lengths the names have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.functions.numbers import py_fixed
from callsight.functions.scalars import one_row, one_value
from callsight.functions.templates import fill
from callsight.operators import themes as H

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: keywords and answer texts.
# ---------------------------------------------------------------------------
COACHING_KEYWORDS = ("coaching", "theme", "improve", "recommendation")
SQL_KEYWORDS = ("how many", "count", "average", "total", "list all")
TOP_THEME_WORDS = ("top", "theme")
COUNT_CALLS_PHRASE = "how many calls"
COUNT_AGENTS_PHRASE = "how many agents"
AVG_SENTIMENT_PHRASE = "average sentiment"
TOP_THEMES_HEADER = "**Top coaching themes:**\n"
TOP_THEME_LINE = "- {theme}: {n} agents"
AGENT_NEEDS_HEADER = "**Coaching needs for {agent}:**\n"
AGENT_NEED_LINE = "- **{theme}** ({priority} priority): {recommendation}"
ANSWER_LINE_SEPARATOR = "\n"
COUNT_CALLS_TEXT = "There are {n} calls in the dataset."
COUNT_AGENTS_TEXT = "There are {n} agents in the dataset."
AVG_SENTIMENT_TEXT = "The average sentiment score is {x}."
NO_SENTIMENT_TEXT = "Sentiment data not available in the transcripts."
HELP_TEXT = "I can answer questions about call counts, agent counts, and sentiment averages. Try rephrasing!"
# ---------------------------------------------------------------------------


def _any_contains(q, words) -> F.Column:
    out = None
    for w in words:
        c = q.contains(w)
        out = c if out is None else (out | c)
    return out


#: Characters of the grams that names are found by.
GRAM = 4


def _grams(text: Column, n: Column | int) -> Column:
    """The different substrings of length ``n``; none of a shorter text."""
    size = F.lit(n) if isinstance(n, int) else n
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def name_anchors(agents: DataFrame) -> DataFrame:
    """(agent, needle, gram): each lower-cased name and its rarest q-gram; a name shorter than that is its own."""
    names = agents.select("agent").where(F.col("agent").isNotNull()).distinct().select("agent", F.lower("agent").alias("needle"))
    each = names.select("agent", "needle", F.explode(F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(_grams(F.col("needle"), GRAM))).alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "gram").groupBy("agent", "needle").agg(F.min(F.struct("n", "gram")).alias("m"))
    return rarest.select("agent", "needle", "m.gram")


def agent_mentions(questions: DataFrame, agents: DataFrame) -> DataFrame:
    """Per question: the first agent (in agent order) whose lower-cased name occurs in the question.

    Grams are taken once per distinct question text (a repeated question
    collapses in the map-side distinct), then the per-text result is joined
    back to the question ids.
    """
    anchors = name_anchors(agents)
    # Which names are shorter than a gram: at most GRAM different lengths.
    short = one_value(anchors.where(F.length("gram") < GRAM).agg(F.collect_set(F.length("gram")).alias("lens")))
    texts = questions.select(F.lower("question").alias("q")).where(F.col("q").isNotNull()).distinct().withColumn("short", short)
    below = F.flatten(F.transform("short", lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(_grams(F.col("q"), n))))
    offered = texts.select("q", F.explode(F.concat(_grams(F.col("q"), GRAM), below)).alias("gram"))
    found = offered.join(anchors, "gram").where(F.col("q").contains(F.col("needle")))
    per_text = found.groupBy("q").agg(F.min("agent").alias("agent"))
    return (
        questions.select("question_id", F.lower("question").alias("q"))
        .join(per_text, "q")  # a question that many ask is a hot key of a plain join, which Spark splits
        .select("question_id", "agent")
    )


def route_questions(questions: DataFrame, agents: DataFrame, has_coaching: DataFrame) -> DataFrame:
    """Per question: route in {top_themes, agent_needs, count_calls, count_agents, avg_sentiment, help, llm}.

    ``has_coaching`` is a one-row table with a boolean ``has_coaching``.
    """
    m = agent_mentions(questions, agents)
    q = F.lower(F.col("question"))
    # The flag is attached as a column once, so the plan holds one subquery for it.
    base = questions.join(m, "question_id", "left").select("*", one_value(has_coaching, "has_coaching").alias("_has"))
    step1 = F.col("_has") & _any_contains(q, COACHING_KEYWORDS)
    route = (
        F.when(step1 & q.contains(TOP_THEME_WORDS[0]) & q.contains(TOP_THEME_WORDS[1]), F.lit("top_themes"))
        .when(step1 & F.col("agent").isNotNull(), F.lit("agent_needs"))
        .when(_any_contains(q, SQL_KEYWORDS) & q.contains(COUNT_CALLS_PHRASE), F.lit("count_calls"))
        .when(_any_contains(q, SQL_KEYWORDS) & q.contains(COUNT_AGENTS_PHRASE), F.lit("count_agents"))
        .when(_any_contains(q, SQL_KEYWORDS) & q.contains(AVG_SENTIMENT_PHRASE), F.lit("avg_sentiment"))
        .when(_any_contains(q, SQL_KEYWORDS), F.lit("help"))
        .otherwise(F.lit("llm"))
    )
    return base.select(
        "question_id",
        "question",
        route.alias("route"),
        F.when(route == "agent_needs", F.col("agent")).alias("agent"),
    )


def answer_questions(questions: DataFrame, turns: DataFrame, cache: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Routed questions joined to the answer tables; ``llm`` questions get a null answer.

    ``cache`` is the flat theme table (agent, theme_pos, theme, priority, recommendation); ``agents`` adds agents without
    themes, whose questions are routed to an empty list of needs.
    """
    # The flag, the names and the top themes are read off one theme table; needs read the rows' texts.
    table = H.theme_table(cache)
    has = H.priority_split(table.withColumn("priority", F.lit("high"))).select((F.col("high") > 0).alias("has_coaching"))
    names = table.groupBy("agent").agg(F.sum("n").alias("n")).where("n > 0").select("agent")
    agents = names if agents is None else names.unionByName(agents.select("agent")).distinct()
    routed = route_questions(questions, agents, has)

    top = H.top_of(table, 5).agg(
        F.array_sort(F.collect_list(F.struct("rank", "theme", "n"))).alias("t")  # 5 rows
    ).select(
        F.concat(
            F.lit(TOP_THEMES_HEADER),
            F.array_join(
                F.transform("t", lambda x: fill(TOP_THEME_LINE, {"theme": x["theme"], "n": x["n"].cast("string")})), ANSWER_LINE_SEPARATOR
            ),
        ).alias("top_answer")
    )
    # Needs texts for every agent (≤ 3 themes each); the left join below keeps
    # the mentioned ones, so the routing is planned once, not again as a filter.
    needs = (
        H.agent_needs(cache, 3)
        .groupBy("agent")
        .agg(F.array_sort(F.collect_list(F.struct("need_rank", "theme", "priority", "recommendation"))).alias("n"))  # ≤ 3
        .select(
            "agent",
            F.concat(
                fill(AGENT_NEEDS_HEADER, {"agent": F.col("agent")}),
                F.array_join(
                    F.transform(
                        "n",
                        lambda x: fill(
                            AGENT_NEED_LINE, {"theme": x["theme"], "priority": x["priority"], "recommendation": x["recommendation"]}
                        ),
                    ),
                    ANSWER_LINE_SEPARATOR,
                ),
            ).alias("needs_answer"),
        )
    )
    metrics = H.call_totals(turns).select(F.col("total_calls").alias("n_calls"), F.col("total_agents").alias("n_agents"), F.col("avg_sentiment").alias("avg_s"))
    # The one-row answers are built inside their one-row tables and attached as
    # columns once: each scalar subquery appears once in the plan.
    texts = metrics.select(
        fill(COUNT_CALLS_TEXT, {"n": F.col("n_calls").cast("string")}).alias("calls_text"),
        fill(COUNT_AGENTS_TEXT, {"n": F.col("n_agents").cast("string")}).alias("agents_text"),
        F.when(F.col("avg_s").isNull(), F.lit(NO_SENTIMENT_TEXT))
        .otherwise(fill(AVG_SENTIMENT_TEXT, {"x": py_fixed(F.col("avg_s"), 2)}))
        .alias("sentiment_text"),
    )
    j = routed.join(needs, "agent", "left").select("*", one_value(top, "top_answer").alias("_top"), one_row(texts).alias("_m"))
    r = F.col("route")
    answer = (
        F.when(r == "top_themes", F.col("_top"))
        .when(r == "agent_needs", F.coalesce("needs_answer", fill(AGENT_NEEDS_HEADER, {"agent": F.col("agent")})))
        .when(r == "count_calls", F.col("_m.calls_text"))
        .when(r == "count_agents", F.col("_m.agents_text"))
        .when(r == "avg_sentiment", F.col("_m.sentiment_text"))
        .when(r == "help", F.lit(HELP_TEXT))
    )
    return j.select("question_id", "question", "route", "agent", answer.alias("answer"))
