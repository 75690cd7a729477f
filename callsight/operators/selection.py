"""Choosing what goes to review: eligible agents, worst calls, first messages, batches.

Per-agent work is reduced to (agent, call) first, so no window ever holds
an agent's turns. Top-k windows are written as ``row_number() <= k`` so
Spark inserts a partial WindowGroupLimit before the shuffle: each map task
forwards at most k rows per key, which keeps a hot agent (or hot call) from
landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsight.operators import agents as A
from callsight.operators.ordinal import with_global_ordinal


def eligible_agents(turns: DataFrame, min_calls: int = 10) -> DataFrame:
    """Agents with at least ``min_calls`` distinct calls."""
    return A.agent_call_counts(turns).where(F.col("n_calls") >= min_calls)


def excluded_agents(turns: DataFrame, min_calls: int = 10) -> DataFrame:
    """Agents with fewer than ``min_calls`` distinct calls."""
    return A.agent_call_counts(turns).where(F.col("n_calls") < min_calls)


def eligibility_summary(turns: DataFrame, min_calls: int = 10) -> DataFrame:
    """One row: eligible and excluded agent counts."""
    c = A.agent_call_counts(turns)
    return c.agg(
        F.sum(F.when(F.col("n_calls") >= min_calls, 1).otherwise(0)).cast("bigint").alias("eligible_agents"),
        F.sum(F.when(F.col("n_calls") < min_calls, 1).otherwise(0)).cast("bigint").alias("excluded_agents"),
    )


def new_agents(turns: DataFrame, previous_agents: DataFrame, min_calls: int = 10) -> DataFrame:
    """Eligible agents not yet analysed by an earlier session (anti join)."""
    prev = previous_agents.select("agent").where(F.col("agent").isNotNull()).distinct()
    return eligible_agents(turns, min_calls).join(prev, "agent", "left_anti")


def filter_to_agents(turns: DataFrame, agents: DataFrame, salts: int | None = None) -> DataFrame:
    """Turns of the listed agents: a plain semi join, which Spark broadcasts or splits by the sizes it sees at run time.

    For a list too large to broadcast, ``salts`` spreads each agent's turns
    over so many keys, and gives every agent of the list once per key: an
    agent with a third of all turns then meets its name in many tasks, without
    relying on a split at run time. The list grows by that factor.
    """
    names = agents.select("agent").distinct()
    if salts is None:
        return turns.join(names, "agent", "left_semi").select(*turns.columns)
    if salts < 1:
        raise ValueError("one salt at least")
    name, salt = "_agent", "_salt"
    listed = names.select(F.col("agent").alias(name), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias(salt))
    dealt = F.pmod(F.xxhash64("call_id", "turn_idx"), F.lit(salts))
    return turns.join(listed, (turns["agent"] == listed[name]) & (dealt == listed[salt]), "left_semi").select(*turns.columns)


def call_means(turns: DataFrame) -> DataFrame:
    """Per (agent, call): mean sentiment with NaN skipped (null when unscored); null agents dropped.

    One row per call: the table every per-agent selection below works on.
    """
    s = F.col("sentiment_score")
    return turns.where(F.col("agent").isNotNull()).groupBy("agent", "call_id").agg(
        F.avg(F.when(~F.isnan(s), s)).alias("avg_sentiment")
    )


def head_means(heads: DataFrame) -> DataFrame:
    """``call_means`` from ``call_heads`` rows: each row's score counts once for each of its turns."""
    s = F.col("sentiment_score")
    scored = F.when(~F.isnan(s), s)
    turns = F.col("n_turns")
    total = F.sum(F.when(scored.isNotNull(), turns))
    mean = F.when(F.min(scored) == F.max(scored), F.min(scored)).otherwise(F.sum(scored * turns) / total)  # one score: exactly that
    return heads.where(F.col("agent").isNotNull()).groupBy("agent", "call_id").agg(mean.alias("avg_sentiment"))


def worst_calls(turns: DataFrame, k: int = 5) -> DataFrame:
    """Per agent the ``k`` calls with the lowest mean sentiment (ties by call_id).

    If an agent has no scored call at all, its first ``k`` calls by call_id
    are taken instead. When an agent has some scores, unscored calls are not
    candidates. Output: agent, call_id, avg_sentiment (null if unscored), rank.
    """
    return _worst_of(call_means(turns), k)


def _worst_of(per_call: DataFrame, k: int) -> DataFrame:
    # Scored calls sort first, so "the agent has a scored call" is visible in
    # its top k alone; the ranking keeps at most k rows per agent per task.
    w = Window.partitionBy("agent").orderBy(F.col("avg_sentiment").asc_nulls_last(), F.col("call_id"))
    top = per_call.select("agent", "call_id", "avg_sentiment", F.row_number().over(w).alias("call_rank")).where(
        F.col("call_rank") <= k
    )
    any_scored = F.max(F.col("avg_sentiment").isNotNull().cast("int")).over(Window.partitionBy("agent"))
    return (
        top.withColumn("_any", any_scored)
        .where(F.col("avg_sentiment").isNotNull() | (F.col("_any") == 0))
        .select("agent", "call_id", "avg_sentiment", F.col("call_rank").cast("int"))
    )


def selected_turns(turns: DataFrame, selected_calls: DataFrame) -> DataFrame:
    """Turns of the selected (agent, call) pairs.

    A plain semi join: a small pair list is broadcast at run time and the turn
    scan filtered where it is read; a large one is joined on (agent, call_id),
    a call-level key with no hot agent.
    """
    keys = selected_calls.select("agent", "call_id")
    return turns.join(keys, ["agent", "call_id"], "left_semi").select(*turns.columns)


def calls_analyzed(selected_calls: DataFrame) -> DataFrame:
    """Per agent the number of its calls that went to review."""
    return selected_calls.groupBy("agent").agg(F.countDistinct("call_id").cast("bigint").alias("calls_analyzed"))


def review_calls(turns: DataFrame, min_calls: int = 10, k: int = 5, previous_agents: DataFrame | None = None) -> DataFrame:
    """The worst ``k`` calls of every eligible (and, given earlier sessions, new) agent.

    Everything happens on the one-row-per-call table: per agent the top k
    (partial WindowGroupLimit before the shuffle) and the call count
    (partial aggregation), then the ≤ k rows per agent are filtered to the
    eligible agents. Both sides of that filter have at most k rows per
    agent, so no join here ever sees a hot agent's calls, let alone its turns.
    """
    return _review_of(call_means(turns), min_calls, k, previous_agents)


def review_heads(heads: DataFrame, min_calls: int = 10, k: int = 5, previous_agents: DataFrame | None = None) -> DataFrame:
    """``review_calls`` from ``call_heads`` rows."""
    return _review_of(head_means(heads), min_calls, k, previous_agents)


def _review_of(per_call: DataFrame, min_calls: int, k: int, previous_agents: DataFrame | None) -> DataFrame:
    counts = per_call.groupBy("agent").agg(F.count("call_id").alias("n_calls"))
    agents = counts.where(F.col("n_calls") >= min_calls).select("agent")
    if previous_agents is not None:
        prev = previous_agents.select("agent").where(F.col("agent").isNotNull()).distinct()
        agents = agents.join(prev, "agent", "left_anti")
    return _worst_of(per_call, k).join(agents, "agent", "left_semi")


def review_turns(turns: DataFrame, min_calls: int = 10, k: int = 5, previous_agents: DataFrame | None = None) -> DataFrame:
    """Eligible (and new) agents → their worst ``k`` calls → those calls' turns."""
    return selected_turns(turns, review_calls(turns, min_calls, k, previous_agents))


def speaker_turns(turns: DataFrame, speaker: str) -> DataFrame:
    """Turns of one normalized speaker side ('agent' or 'customer')."""
    return turns.where(F.col("speaker") == speaker)


def first_messages(turns: DataFrame, n: int = 3, speakers: tuple[str, ...] = ("agent", "customer")) -> DataFrame:
    """First ``n`` messages per (agent, call, speaker side) in turn order (equal turn numbers tie on the text).

    A call that two agents share has its first messages for each of them.
    """
    w = Window.partitionBy("agent", "call_id", "speaker").orderBy("turn_idx", "message")
    return (
        turns.where(F.col("speaker").isin(*speakers))
        .select("agent", "call_id", "speaker", "turn_idx", "message", F.row_number().over(w).alias("msg_rank"))
        .where(F.col("msg_rank") <= n)
        .withColumn("msg_rank", F.col("msg_rank").cast("int"))
    )


def first_of_heads(heads: DataFrame, n: int = 3) -> DataFrame:
    """``first_messages`` from ``call_heads`` rows: at most ``n`` messages of a side and row are ranked, never a call's turns."""
    sides = F.array(*(F.struct(F.lit(side).alias("speaker"), F.col(c).alias("items")) for side, c in (("customer", "customer"), ("agent", "agent_side"))))
    rows = heads.select("agent", "call_id", F.explode(sides).alias("s")).select("agent", "call_id", "s.speaker", F.explode("s.items").alias("m"))
    return first_messages(rows.select("agent", "call_id", "speaker", "m.turn_idx", "m.message"), n)


def call_ordinal(selected: DataFrame) -> DataFrame:
    """1..n number of each selected call inside its agent, by first appearance (call_id order).

    ``selected`` holds at most k calls per agent (output of ``worst_calls``).
    """
    w = Window.partitionBy("agent").orderBy("call_id")
    return selected.select("agent", "call_id", F.row_number().over(w).cast("int").alias("call_no"))


def agent_batches(agents: DataFrame, batch_size: int = 20) -> DataFrame:
    """Consecutive batches of ``batch_size`` agents in agent order, with a distributed ordinal."""
    ordered = with_global_ordinal(agents.select("agent").distinct(), [F.col("agent")], "agent_ordinal")
    return ordered.select(
        "agent",
        "agent_ordinal",
        (F.floor((F.col("agent_ordinal") - 1) / batch_size) + 1).cast("bigint").alias("batch_no"),
    )
