"""Per-agent statistics over the turn table.

All aggregates are single-pass ``groupBy`` with map-side partial
aggregation. ``countDistinct(call_id)`` with one distinct column is planned
as a two-step aggregate keyed first on (agent, call_id), so a hot agent's
rows are spread over call ids before the final per-agent merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.functions.scalars import one_value


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _np_round(c: Column, digits: int) -> Column:
    """numpy/pandas rounding: scale, round half to even on the binary value, unscale.

    The 12th digit is rounded first: below it, a mean depends on the order in which partitions were summed.
    """
    scale = float(10**digits)
    return F.rint(F.round(c, 12) * scale) / scale


def _distinct(c: str, approx_rsd: float | None) -> Column:
    """Exact distinct count, or a HyperLogLog++ estimate with relative standard deviation ``approx_rsd`` (opt-in).

    The exact count shuffles every distinct value once; the estimate merges
    fixed-size sketches, which matters for call ids at billions of calls.
    """
    if approx_rsd is None:
        return F.countDistinct(c).cast("bigint")
    return F.approx_count_distinct(c, approx_rsd).cast("bigint")


def total_calls(turns: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    return turns.agg(_distinct("call_id", approx_rsd).alias("total_calls"))


def total_agents(turns: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    return turns.agg(_distinct("agent", approx_rsd).alias("total_agents"))


def volume_counts(turns: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """One row: distinct calls, distinct agents, turns (distinct counts exact unless ``approx_rsd`` is given)."""
    if approx_rsd is not None:
        return turns.agg(
            _distinct("call_id", approx_rsd).alias("total_calls"),
            _distinct("agent", approx_rsd).alias("total_agents"),
            F.count(F.lit(1)).cast("bigint").alias("total_turns"),
        )
    # Two distinct counts in one aggregate would send every turn twice (Expand). The turns are first summed up to
    # (agent, call), then to calls and to agents; each count reads those few rows.
    per_call = turns.groupBy("agent", "call_id").agg(F.count(F.lit(1)).alias("n"))
    agents = per_call.groupBy("agent").agg(F.sum("n").alias("n"))
    one = agents.agg(F.count("agent").cast("bigint").alias("total_agents"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_turns"))
    calls = one_value(per_call.agg(F.countDistinct("call_id").cast("bigint").alias("total_calls")))
    return one.select(calls.alias("total_calls"), "total_agents", "total_turns")


def agent_stats(turns: DataFrame) -> DataFrame:
    """Per agent: calls, messages, agent/customer messages, mean message length.

    A null agent forms its own group, as in SQL ``GROUP BY``.
    """
    return turns.groupBy("agent").agg(
        F.countDistinct("call_id").cast("bigint").alias("total_calls"),
        F.count(F.lit(1)).cast("bigint").alias("total_messages"),
        _cnt(F.col("speaker") == "agent").alias("agent_messages"),
        _cnt(F.col("speaker") == "customer").alias("customer_messages"),
        F.avg(F.length("message")).alias("avg_message_length"),
    )


def distinct_call_sentiments(turns: DataFrame) -> DataFrame:
    """DISTINCT (call_id, agent, sentiment_score) rows with a sentiment (NaN counts as missing)."""
    s = F.col("sentiment_score")
    return turns.where(s.isNotNull() & ~F.isnan(s)).select("call_id", "agent", "sentiment_score").distinct()


def sentiment_stats(turns: DataFrame, low_threshold: float = 0.5) -> DataFrame:
    """Per agent over DISTINCT (call, agent, sentiment): mean, min, max, count below the threshold.

    A call with two different sentiment values counts once per value.
    """
    s = F.col("sentiment_score")
    return distinct_call_sentiments(turns).groupBy("agent").agg(
        F.avg(s).alias("avg_sentiment"),
        F.min(s).alias("min_sentiment"),
        F.max(s).alias("max_sentiment"),
        F.count(F.when(s < low_threshold, 1)).cast("bigint").alias("low_sentiment_calls"),
    )


def call_flow(turns: DataFrame) -> DataFrame:
    """Per (call, agent): turns and the share of agent turns (double)."""
    return turns.groupBy("call_id", "agent").agg(
        F.count(F.lit(1)).cast("bigint").alias("turns_per_call"),
        (_cnt(F.col("speaker") == "agent").cast("double") / F.count(F.lit(1)).cast("double")).alias(
            "agent_response_ratio"
        ),
    )


def flow_stats(turns: DataFrame) -> DataFrame:
    """Per agent: mean turns per call and mean agent share, over calls."""
    return call_flow(turns).groupBy("agent").agg(
        F.avg("turns_per_call").alias("avg_turns"),
        F.avg("agent_response_ratio").alias("avg_response_ratio"),
    )


def _per_call(turns: DataFrame, low_threshold: float) -> DataFrame:
    """Per (agent, call): turn counts, length sum, and sum / count / low count of its DISTINCT sentiments.

    Two grouping levels, sums and counts only: first per (agent, call,
    sentiment value) — one row per distinct value, NaN folded into null —
    then per (agent, call). Both levels aggregate partially before their
    shuffle, and nothing is collected, so a call id shared by a third of
    all rows is still just a running sum.
    """
    s = F.col("sentiment_score")
    by_value = turns.groupBy("agent", "call_id", F.when(~F.isnan(s), s).alias("s")).agg(
        F.count(F.lit(1)).alias("n"),
        _cnt(F.col("speaker") == "agent").alias("n_agent"),
        _cnt(F.col("speaker") == "customer").alias("n_customer"),
        F.sum(F.length("message")).alias("len_sum"),
    )
    v = F.col("s")
    return by_value.groupBy("agent", "call_id").agg(
        F.sum("n").alias("n"),
        F.sum("n_agent").alias("n_agent"),
        F.sum("n_customer").alias("n_customer"),
        F.sum("len_sum").alias("len_sum"),
        F.sum(v).alias("s_sum"),
        F.count(v).alias("s_n"),
        F.count(F.when(v < low_threshold, 1)).alias("s_low"),
    )


def agent_dashboard(turns: DataFrame, low_threshold: float = 0.5, rounded: bool = True) -> DataFrame:
    """agent_stats LEFT JOIN sentiment_stats LEFT JOIN flow_stats on agent, from one pass over the turns.

    The three per-agent tables share their grouping levels, so they are
    computed as one aggregation chain (``_per_call``, then per agent): one
    scan, partial aggregation at every level, no join; the null agent is its
    own group as in SQL. Agents without any sentiment get nulls, as the left
    join would. ``rounded`` applies the display rounding: length 1,
    sentiment 2, turns 1, ratio as percent with 1 decimal (half-even on the
    binary value, like pandas).
    """
    per_agent = _per_call(turns, low_threshold).groupBy("agent").agg(
        F.count("call_id").cast("bigint").alias("total_calls"),
        F.sum("n").cast("bigint").alias("total_messages"),
        F.sum("n_agent").cast("bigint").alias("agent_messages"),
        F.sum("n_customer").cast("bigint").alias("customer_messages"),
        (F.sum("len_sum").cast("double") / F.sum("n").cast("double")).alias("avg_message_length"),
        F.sum("s_sum").alias("_s_sum"),
        F.sum("s_n").alias("_s_n"),
        F.sum("s_low").cast("bigint").alias("_s_low"),
        F.avg("n").alias("avg_turns"),
        F.avg(F.col("n_agent").cast("double") / F.col("n").cast("double")).alias("avg_response_ratio"),
    )
    has_s = F.col("_s_n") > 0
    out = per_agent.select(
        "agent",
        "total_calls",
        "total_messages",
        "agent_messages",
        "customer_messages",
        F.col("avg_message_length").alias("avg_message_length"),
        F.when(has_s, F.col("_s_sum") / F.col("_s_n")).alias("avg_sentiment"),
        F.when(has_s, F.col("_s_low")).alias("low_sentiment_calls"),
        F.col("avg_turns").alias("avg_turns"),
        F.col("avg_response_ratio").alias("avg_response_ratio"),
    )
    if not rounded:
        return out
    return out.select(
        "agent",
        "total_calls",
        "total_messages",
        "agent_messages",
        "customer_messages",
        _np_round(F.col("avg_message_length"), 1).alias("avg_message_length"),
        _np_round(F.col("avg_sentiment"), 2).alias("avg_sentiment"),
        "low_sentiment_calls",
        _np_round(F.col("avg_turns"), 1).alias("avg_turns"),
        _np_round(F.col("avg_response_ratio") * 100, 1).alias("avg_response_ratio"),
    )


def kpi_row(turns: DataFrame, low_threshold: float = 0.5) -> DataFrame:
    """One row: calls, agents, mean of per-agent mean sentiment (over distinct values), total messages.

    Turns → per-(agent, call) rows, from which the distinct-call count (a
    scalar subquery) and the per-agent means are computed; the plan reads the
    turns for each of the two.
    """
    per_call = _per_call(turns, low_threshold)
    calls = per_call.agg(F.countDistinct("call_id").cast("bigint").alias("total_calls"))
    per_agent = per_call.groupBy("agent").agg(
        F.sum("n").alias("n"),
        F.sum("s_sum").alias("_s_sum"),
        F.sum("s_n").alias("_s_n"),
    )
    one = per_agent.agg(
        F.count("agent").cast("bigint").alias("total_agents"),
        F.avg(F.when(F.col("_s_n") > 0, F.col("_s_sum") / F.col("_s_n"))).alias("avg_sentiment"),
        F.sum("n").cast("bigint").alias("total_messages"),
    )
    return one.select(one_value(calls).alias("total_calls"), "total_agents", "avg_sentiment", "total_messages")


def avg_sentiment_turns(turns: DataFrame) -> DataFrame:
    """Turn-weighted mean sentiment (NaN skipped), one row."""
    s = F.col("sentiment_score")
    return turns.agg(F.avg(F.when(~F.isnan(s), s)).alias("avg_sentiment"))


def call_sentiment(turns: DataFrame) -> DataFrame:
    """Mean sentiment per (agent, call); calls whose mean is null are dropped."""
    s = F.col("sentiment_score")
    return (
        turns.groupBy("agent", "call_id")
        .agg(F.avg(F.when(~F.isnan(s), s)).alias("avg_sentiment"))
        .where(F.col("avg_sentiment").isNotNull())
        .select("agent", "call_id", F.col("avg_sentiment").alias("avg_sentiment"))
    )


def agent_call_counts(turns: DataFrame) -> DataFrame:
    """Distinct calls per agent; null agents dropped (pandas groupby)."""
    return (
        turns.where(F.col("agent").isNotNull())
        .groupBy("agent")
        .agg(F.countDistinct("call_id").cast("bigint").alias("n_calls"))
    )


def speaker_counts(turns: DataFrame) -> DataFrame:
    """Turns per normalized speaker."""
    return turns.groupBy("speaker").agg(F.count(F.lit(1)).cast("bigint").alias("n_turns"))
