"""Building model request rows from the selected calls (no HTTP here).

Per call: the first three customer and agent messages, truncated, joined
into a digest. Per agent: the digests of its (at most k) selected calls and
a prompt pair, serialised to a JSON payload with ``to_json``. Every group
collected here is bounded by construction (≤ 3 messages per side per call,
≤ k calls per agent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight.functions.numbers import py_fixed
from callsight.functions.templates import fill
from callsight.functions.text import truncate_text
from callsight.operators import selection as S

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: prompt templates and request
# parameters. "{themes}", "{agent}", "{n_calls}", "{digests}" are filled per
# agent; everything else is literal text.
# ---------------------------------------------------------------------------
SYSTEM_PROMPT_TEMPLATE = """You are an expert contact center QA analyst. Analyze agent performance and identify coaching opportunities.

Focus on these themes: {themes}

Provide response as JSON with this exact structure:
{
    "agent": "{agent}",
    "calls_analyzed": {n_calls},
    "coaching_themes": [
        {
            "theme": "theme name from provided list",
            "priority": "high|medium|low",
            "frequency": 1,
            "examples": ["brief example"],
            "recommendation": "specific actionable advice"
        }
    ],
    "strengths": ["strength 1", "strength 2"],
    "overall_sentiment_correlation": "brief insight"
}

CRITICAL: Only use themes from the provided list. Be specific and data-driven. Keep response concise."""

USER_PROMPT_TEMPLATE = """Agent: {agent}
Calls analyzed: {n_calls}

Call Summaries:
{digests}

Identify top 3 coaching opportunities with specific examples and actionable recommendations."""

# The older variant (first 10 calls, untruncated messages, all themes).
LEGACY_SYSTEM_PROMPT_TEMPLATE = """You are an expert contact center QA analyst. Analyze agent performance and identify coaching opportunities.

Focus on these themes: {themes}

Provide response as JSON with this exact structure:
{
    "agent": "agent_name",
    "calls_analyzed": number,
    "coaching_themes": [
        {
            "theme": "theme name from provided list",
            "priority": "high|medium|low",
            "frequency": number,
            "examples": ["specific example 1", "specific example 2"],
            "recommendation": "specific actionable advice"
        }
    ],
    "strengths": ["strength 1", "strength 2"],
    "overall_sentiment_correlation": "insight about sentiment and performance"
}

CRITICAL: Only use themes from the provided list. Be specific and data-driven."""

LEGACY_USER_PROMPT_TEMPLATE = """Agent: {agent}
Calls analyzed: {n_calls}

Call Summaries:
{digests}

Identify top 3-5 coaching opportunities with specific examples and actionable recommendations."""

DIGEST_TEMPLATE = "Call {n}:{sentiment}\n- {customer_label}: {customer}\n- {agent_label}: {agent}"
SENTIMENT_TAG = " [Sentiment: {value}]"
DIGEST_MESSAGE_SEPARATOR = " | "
DIGEST_SEPARATOR = "\n"
CUSTOMER_LABEL = "Customer"
AGENT_LABEL = "Agent"
LEGACY_CUSTOMER_LABEL = "Customer issues"
LEGACY_AGENT_LABEL = "Agent responses"
LEGACY_CALLS_PER_PROMPT = 10

TEMPERATURE = 0.3
MAX_TOKENS = 2000
MESSAGES_PER_SIDE = 3
MESSAGE_CHARS = 100
# ---------------------------------------------------------------------------


def call_digest(
    review: DataFrame,
    calls: DataFrame,
    truncate: int | None = MESSAGE_CHARS,
    customer_label: str = CUSTOMER_LABEL,
    agent_label: str = AGENT_LABEL,
) -> DataFrame:
    """Per selected call: ``call_no`` and the digest text.

    ``review`` = turns of the selected calls; ``calls`` = (agent, call_id) of
    the selected calls. The sentiment tag is printed with two decimals and
    left out when the call's mean is 0 or null. ``truncate=None`` keeps
    whole messages (the older variant).
    """
    s = F.col("sentiment_score")
    means = review.groupBy("agent", "call_id").agg(F.avg(F.when(~F.isnan(s), s)).alias("avg_sentiment"))
    return _digest(S.first_messages(review, MESSAGES_PER_SIDE), means, calls, truncate, customer_label, agent_label)


def digest_of_heads(
    heads: DataFrame,
    calls: DataFrame,
    truncate: int | None = MESSAGE_CHARS,
    customer_label: str = CUSTOMER_LABEL,
    agent_label: str = AGENT_LABEL,
) -> DataFrame:
    """``call_digest`` from ``call_heads`` rows, so that no turn is read again; ``calls`` may carry ``avg_sentiment``."""
    review = heads.join(calls.select("agent", "call_id"), ["agent", "call_id"], "left_semi")
    means = calls.select("agent", "call_id", "avg_sentiment") if "avg_sentiment" in calls.columns else S.head_means(review)
    return _digest(S.first_of_heads(review, MESSAGES_PER_SIDE), means, calls, truncate, customer_label, agent_label)


def _digest(firsts: DataFrame, means: DataFrame, calls: DataFrame, truncate: int | None, customer_label: str, agent_label: str) -> DataFrame:
    short = truncate_text("message", truncate) if truncate else F.col("message")
    firsts = firsts.select("agent", "call_id", "speaker", "msg_rank", short.alias("short"))
    sides = firsts.groupBy("agent", "call_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("speaker") == "customer", F.struct("msg_rank", "short")))).alias("cust"),
        F.array_sort(F.collect_list(F.when(F.col("speaker") == "agent", F.struct("msg_rank", "short")))).alias("agt"),
    )
    ordinals = S.call_ordinal(calls)
    j = ordinals.join(means, ["agent", "call_id"], "left").join(sides, ["agent", "call_id"], "left")
    tag = F.when(
        F.col("avg_sentiment").isNotNull() & (F.col("avg_sentiment") != 0),
        fill(SENTIMENT_TAG, {"value": py_fixed(F.col("avg_sentiment"), 2)}),
    ).otherwise(F.lit(""))
    cust = F.array_join(F.transform(F.coalesce("cust", F.array()), lambda x: x["short"]), DIGEST_MESSAGE_SEPARATOR)
    agt = F.array_join(F.transform(F.coalesce("agt", F.array()), lambda x: x["short"]), DIGEST_MESSAGE_SEPARATOR)
    digest = fill(
        DIGEST_TEMPLATE,
        {
            "n": F.col("call_no").cast("string"),
            "sentiment": tag,
            "customer_label": F.lit(customer_label),
            "customer": cust,
            "agent_label": F.lit(agent_label),
            "agent": agt,
        },
    )
    return j.select("agent", "call_id", "call_no", digest.alias("digest"))


def first_calls(turns: DataFrame, n: int | None = None) -> DataFrame:
    """Per agent its calls, or the first ``n`` by call order."""
    w = Window.partitionBy("agent").orderBy("call_id")
    calls = turns.where(F.col("agent").isNotNull()).select("agent", "call_id").distinct()
    if n is None:
        return calls
    return calls.select("agent", "call_id", F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= n).drop("_rn")


def call_digest_wide(heads: DataFrame, n_calls: int | None = None) -> DataFrame:
    """Older digest variant, from ``call_heads`` rows: every call (or the first ``n_calls`` per agent), whole messages, 'issues/responses' labels."""
    return digest_of_heads(heads, first_calls(heads, n_calls), None, LEGACY_CUSTOMER_LABEL, LEGACY_AGENT_LABEL)


def agent_prompts(
    digests: DataFrame, themes: list[str], legacy: bool = False, n_calls: DataFrame | None = None, theme_limit: int | None = None, per_prompt: int | None = None
) -> DataFrame:
    """Per agent: system and user prompt from its call digests (≤ k per agent).

    ``legacy`` uses the older templates; its call count is the agent's total
    calls, given as ``n_calls(agent, n_calls)``. Every theme reaches the
    prompt unless ``theme_limit`` says how many. With ``per_prompt`` an agent
    gets as many prompts as its calls need, so many calls each, numbered by
    ``part`` from 1 on: no call is left out and every prompt stays bounded.
    """
    keys = ["agent"]
    if per_prompt is not None:
        digests = digests.withColumn("part", (F.floor((F.col("call_no") - 1) / per_prompt) + 1).cast("int"))
        keys.append("part")
    per_agent = digests.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("call_no", "digest"))).alias("d"),
        F.count(F.lit(1)).cast("bigint").alias("n_calls"),
    )
    if n_calls is not None:
        per_agent = per_agent.drop("n_calls").join(n_calls.select("agent", F.col("n_calls").cast("bigint")), "agent", "left")
    theme_text = F.lit(", ".join(themes[:theme_limit]))
    vals = {
        "themes": theme_text,
        "agent": F.col("agent"),
        "n_calls": F.col("n_calls").cast("string"),
        "digests": F.array_join(F.transform("d", lambda x: x["digest"]), DIGEST_SEPARATOR),
    }
    return per_agent.select(
        *keys,
        "n_calls",
        fill(LEGACY_SYSTEM_PROMPT_TEMPLATE if legacy else SYSTEM_PROMPT_TEMPLATE, vals).alias("system_prompt"),
        fill(LEGACY_USER_PROMPT_TEMPLATE if legacy else USER_PROMPT_TEMPLATE, vals).alias("user_prompt"),
    )


def request_rows(prompts: DataFrame, batches: DataFrame, model: str, provider: str = "hosted", json_mode: bool = True) -> DataFrame:
    """Per agent: batch number and the JSON request payload.

    ``response_format`` is only sent to the hosted provider in JSON mode.
    """
    fields = [
        F.lit(model).alias("model"),
        F.array(
            F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("user_prompt").alias("content")),
        ).alias("messages"),
        F.lit(TEMPERATURE).alias("temperature"),
        F.lit(MAX_TOKENS).alias("max_tokens"),
    ]
    if json_mode and provider == "hosted":
        fields.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    j = prompts.join(batches.select("agent", "batch_no"), "agent")
    return j.select("agent", "batch_no", F.to_json(F.struct(*fields)).alias("payload"))
