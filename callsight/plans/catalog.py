"""Registered queries: name → (spark, sf_dir) → DataFrame, plus DuckDB oracles.

Each query reads the driver's tables (or data Spark derives from them), so
its work grows with the tables. Oracles recompute the same result in DuckDB
SQL from the source tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.functions.scalars import one_value
from callsight.operators import agents as A
from callsight.operators import transcripts as P
from callsight.plans import fixtures as X
from callsight.plans import oracle as O
from callsight.functions.text import pad_left
from callsight.session import ensure_checkpoint_dir, scratch_path, table_version, when_removed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


#: Keys whose fractions are rounded for the comparison alone; the library returns them whole.
SIX_DIGITS = {
    "agent_stats", "sentiment_stats", "flow_stats", "kpi_row", "avg_sentiment_turns", "call_sentiment", "worst_calls",
    "theme_counts", "theme_bars", "pillar_top_agents", "pillar_cards", "report_header", "exec_summary", "analytics_context",
}


def six_digits(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _prepared(fn: Query) -> Query:
    """Session prerequisites every query relies on, set on whatever session the caller passes."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        ensure_checkpoint_dir(spark)  # shared folder from spark.checkpoint.dir; a scratch one only if unset
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # last duplicate JSON key wins, as in Python
        return fn(spark, sf)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = _prepared(fn if name not in SIX_DIGITS else lambda spark, sf: six_digits(fn(spark, sf)))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# -- shared inputs -----------------------------------------------------------


_LANDED: dict[tuple[str, ...], dict[str, str]] = {}
when_removed(_LANDED.clear)


def _input_key(spark: SparkSession, sf: str, *tables: str) -> tuple[str, ...]:
    """Names a written copy by what it was made of: the session, and the input tables as they are now."""
    return spark.sparkContext.applicationId, sf, *(table_version(spark, f"{sf.rstrip('/')}/{t}.parquet") for t in tables)


def land_inputs(spark: SparkSession, sf: str) -> None:
    """Writes the derived inputs (calls, theme rows, responses) of a dataset once; later queries of this session read them.

    For measurements: the queries are then timed without making their inputs.
    """
    key = _input_key(spark, sf, "conversations", "documents")
    if key in _LANDED:
        return
    made = {"calls": calls(spark, sf), "theme_rows": theme_rows(spark, sf)}
    made["responses"] = X.responses_from_theme_rows(made["theme_rows"])
    paths = {name: scratch_path(spark, name) for name in made}
    for name, df in made.items():
        df.write.parquet(paths[name])
    _LANDED[key] = paths


def _landed(spark: SparkSession, sf: str, name: str) -> DataFrame | None:
    paths = _LANDED.get(_input_key(spark, sf, "conversations", "documents")) if _LANDED else None
    return spark.read.parquet(paths[name]) if paths else None


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return _landed(spark, sf, "calls") or X.calls_from_conversations(X.read_table(spark, sf, "conversations"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return P.parse_turns(calls(spark, sf))


def counted_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns for queries that count and never read a message: the same rows, without redaction."""
    return P.parse_turns(calls(spark, sf), redact=False)


def theme_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _landed(spark, sf, "theme_rows") or X.theme_rows_from_documents(X.read_table(spark, sf, "documents"))


TC = O.TURN_CTES

# -- parsing -----------------------------------------------------------------

register(
    "parse_turns",
    TC + "SELECT call_id, agent, turn_idx, timestamp, speaker, message, sentiment_score FROM turns",
)(turns)

TCC = O.with_ctes(O.TURNS_SRC, O.CALLS, O.TURNS)

register(
    "parse_turns_original",
    TCC + """SELECT t.call_id, t.agent, t.turn_idx, t.timestamp, t.speaker, t.message, t.sentiment_score, c.transcript AS original_transcript
    FROM turns t JOIN calls c ON c.call_id = t.call_id""",
)(lambda spark, sf: P.parse_turns(calls(spark, sf), keep_original=True))

register(
    "detect_format",
    TCC + """SELECT call_id, agent,
      CASE WHEN transcript IS NULL THEN NULL WHEN instr(transcript, '|') > 0 THEN 'pipe' ELSE 'bracket' END AS format
    FROM calls""",
)(lambda spark, sf: P.call_formats(calls(spark, sf)))

register(
    "parse_summary",
    TCC + """SELECT c.call_id, c.agent,
      CASE WHEN instr(c.transcript, '|') > 0 THEN 'pipe' ELSE 'bracket' END AS format,
      cast(coalesce(t.n, 0) AS bigint) AS n_turns
    FROM calls c LEFT JOIN (SELECT call_id, count(*) AS n FROM turns GROUP BY call_id) t ON t.call_id = c.call_id""",
)(lambda spark, sf: P.parse_summary(calls(spark, sf)))

register(
    "speaker_counts",
    TC + "SELECT speaker, cast(count(*) AS bigint) AS n_turns FROM turns GROUP BY speaker",
)(lambda spark, sf: A.speaker_counts(counted_turns(spark, sf)))

# -- per-agent statistics ----------------------------------------------------

# Per-call rows first, then agents: the library aggregates the turns, the oracle aggregates calls.
_CALLS_SQL = """(SELECT agent, call_id, count(*) AS n, count(*) FILTER (WHERE speaker = 'agent') AS n_agent,
    count(*) FILTER (WHERE speaker = 'customer') AS n_customer, sum(length(message)) AS n_chars FROM turns GROUP BY agent, call_id)"""
_SCORES_SQL = "(SELECT agent, call_id, sentiment_score AS s FROM turns WHERE sentiment_score IS NOT NULL GROUP BY ALL)"
AGENT_STATS_SQL = f"""SELECT agent, cast(count(call_id) AS bigint) AS total_calls, cast(sum(n) AS bigint) AS total_messages,
    cast(sum(n_agent) AS bigint) AS agent_messages, cast(sum(n_customer) AS bigint) AS customer_messages,
    sum(n_chars) / sum(n) AS avg_message_length FROM {_CALLS_SQL} GROUP BY agent"""
SENTIMENT_STATS_SQL = f"""SELECT agent, avg(s) AS avg_sentiment, min(s) AS min_sentiment, max(s) AS max_sentiment,
    cast(count(*) FILTER (WHERE s < 0.5) AS bigint) AS low_sentiment_calls FROM {_SCORES_SQL} GROUP BY agent"""
FLOW_STATS_SQL = f"""SELECT agent, avg(n) AS avg_turns, avg(n_agent / n) AS avg_response_ratio FROM {_CALLS_SQL} GROUP BY agent"""


def six_digits_sql(sql: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({sql})"


register("agent_stats", TC + six_digits_sql(AGENT_STATS_SQL, "avg_message_length"))(lambda spark, sf: A.agent_stats(turns(spark, sf)))
register("sentiment_stats", TC + six_digits_sql(SENTIMENT_STATS_SQL, "avg_sentiment"))(
    lambda spark, sf: A.sentiment_stats(counted_turns(spark, sf))
)
register("flow_stats", TC + six_digits_sql(FLOW_STATS_SQL, "avg_turns", "avg_response_ratio"))(
    lambda spark, sf: A.flow_stats(counted_turns(spark, sf))
)

register(
    "volume_counts",
    TC + """SELECT cast(count(DISTINCT call_id) AS bigint) AS total_calls,
      cast(count(DISTINCT agent) AS bigint) AS total_agents, cast(count(*) AS bigint) AS total_turns FROM turns""",
)(lambda spark, sf: A.volume_counts(counted_turns(spark, sf)))

register(
    "kpi_row",
    TC + f"""SELECT cast(count(DISTINCT call_id) AS bigint) AS total_calls,
      cast(count(DISTINCT agent) AS bigint) AS total_agents,
      (SELECT round(avg(avg_sentiment), 6) FROM ({SENTIMENT_STATS_SQL})) AS avg_sentiment,
      cast(count(*) AS bigint) AS total_messages
    FROM turns""",
)(lambda spark, sf: A.kpi_row(counted_turns(spark, sf)))

register(
    "avg_sentiment_turns",
    TC + "SELECT round(avg(sentiment_score), 6) AS avg_sentiment FROM turns",
)(lambda spark, sf: A.avg_sentiment_turns(counted_turns(spark, sf)))

register(
    "call_sentiment",
    TC + """SELECT agent, call_id, round(avg(sentiment_score), 6) AS avg_sentiment
    FROM turns GROUP BY agent, call_id HAVING avg(sentiment_score) IS NOT NULL""",
)(lambda spark, sf: A.call_sentiment(counted_turns(spark, sf)))

AGENT_CALLS_SQL = """SELECT agent, cast(count(DISTINCT call_id) AS bigint) AS n_calls
  FROM turns WHERE agent IS NOT NULL GROUP BY agent"""
register("agent_call_counts", TC + AGENT_CALLS_SQL)(lambda spark, sf: A.agent_call_counts(counted_turns(spark, sf)))

register(
    "agent_dashboard",
    # Twelve digits take out what the order of summation leaves; then the display rounding.
    TC + f"""SELECT a.agent, total_calls, total_messages, agent_messages, customer_messages,
      round_even(round(avg_message_length, 12) * 10, 0) / 10 AS avg_message_length,
      round_even(round(avg_sentiment, 12) * 100, 0) / 100 AS avg_sentiment,
      low_sentiment_calls,
      round_even(round(avg_turns, 12) * 10, 0) / 10 AS avg_turns,
      round_even(round(avg_response_ratio * 100, 12) * 10, 0) / 10 AS avg_response_ratio
    FROM ({AGENT_STATS_SQL}) a
    LEFT JOIN ({SENTIMENT_STATS_SQL}) s ON a.agent IS NOT DISTINCT FROM s.agent
    LEFT JOIN ({FLOW_STATS_SQL}) f ON a.agent IS NOT DISTINCT FROM f.agent""",
)(lambda spark, sf: A.agent_dashboard(turns(spark, sf)))

# -- selection ---------------------------------------------------------------

from callsight.operators import selection as S  # noqa: E402

MIN_CALLS = 10
register(
    "eligible_agents", TC + f"SELECT * FROM ({AGENT_CALLS_SQL}) WHERE n_calls >= {MIN_CALLS}"
)(lambda spark, sf: S.eligible_agents(counted_turns(spark, sf), MIN_CALLS))
register(
    "excluded_agents", TC + f"SELECT * FROM ({AGENT_CALLS_SQL}) WHERE n_calls < {MIN_CALLS}"
)(lambda spark, sf: S.excluded_agents(counted_turns(spark, sf), MIN_CALLS))
register(
    "eligibility_summary",
    TC + f"""SELECT cast(sum(CASE WHEN n_calls >= {MIN_CALLS} THEN 1 ELSE 0 END) AS bigint) AS eligible_agents,
      cast(sum(CASE WHEN n_calls < {MIN_CALLS} THEN 1 ELSE 0 END) AS bigint) AS excluded_agents
    FROM ({AGENT_CALLS_SQL})""",
)(lambda spark, sf: S.eligibility_summary(counted_turns(spark, sf), MIN_CALLS))

PREV_AGENTS_SQL = "SELECT DISTINCT agent FROM turns WHERE agent IS NOT NULL AND cast(right(agent, 1) AS int) % 2 = 0"
register(
    "new_agents",
    TC + f"""SELECT e.* FROM ({AGENT_CALLS_SQL}) e WHERE n_calls >= {MIN_CALLS}
      AND agent NOT IN ({PREV_AGENTS_SQL})""",
)(lambda spark, sf: S.new_agents(counted_turns(spark, sf), X.previous_session_agents(counted_turns(spark, sf)), MIN_CALLS))

WORST_CALLS_SQL = """SELECT agent, call_id, round(avg_sentiment, 6) AS avg_sentiment, cast(call_rank AS int) AS call_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY agent ORDER BY avg_sentiment ASC NULLS LAST, call_id) AS call_rank,
      max(CASE WHEN avg_sentiment IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY agent) AS any_scored
    FROM (SELECT agent, call_id, avg(sentiment_score) AS avg_sentiment FROM turns WHERE agent IS NOT NULL
          GROUP BY agent, call_id))
  WHERE call_rank <= 5 AND (avg_sentiment IS NOT NULL OR any_scored = 0)"""
register("worst_calls", TC + WORST_CALLS_SQL)(lambda spark, sf: S.worst_calls(counted_turns(spark, sf), 5))

REVIEW_TURNS_SQL = f"""SELECT t.* FROM turns t
  WHERE t.agent IN (SELECT agent FROM ({AGENT_CALLS_SQL}) WHERE n_calls >= {MIN_CALLS})
    AND (t.agent, t.call_id) IN (SELECT (agent, call_id) FROM ({WORST_CALLS_SQL}))"""
register(
    "selected_turns", TC + REVIEW_TURNS_SQL
)(lambda spark, sf: S.review_turns(stored_turns(spark, sf), MIN_CALLS, 5))

register(
    "first_messages",
    TC + """SELECT agent, call_id, speaker, turn_idx, message, cast(msg_rank AS int) AS msg_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY agent, call_id, speaker ORDER BY turn_idx) AS msg_rank
      FROM turns WHERE speaker IN ('agent', 'customer')) WHERE msg_rank <= 3""",
)(lambda spark, sf: S.first_messages(turns(spark, sf), 3))

register(
    "register_turns", TC + "SELECT call_id, agent, turn_idx, timestamp, speaker, message, sentiment_score FROM turns"
)(lambda spark, sf: stored_turns(spark, sf))

register(
    "call_ordinal",
    TC + f"""SELECT agent, call_id, cast(row_number() OVER (PARTITION BY agent ORDER BY call_id) AS int) AS call_no
    FROM ({WORST_CALLS_SQL})""",
)(lambda spark, sf: S.call_ordinal(S.worst_calls(counted_turns(spark, sf), 5)))

# -- theme roll-ups (F3 theme rows from documents) ---------------------------

from callsight.operators import themes as H  # noqa: E402

THC = O.THEME_CTES
BOTH = O.with_ctes(O.TURNS_SRC, O.TURNS, O.lexicon_values(), O.THEME_ROWS)

PILLARS_SQL = "(SELECT DISTINCT pillar_ord, pillar FROM theme_lexicon)"
FIRST_PILLAR_SQL = """fp AS (SELECT r.agent, r.theme_pos, r.priority, min(l.pillar_ord) AS po
    FROM theme_rows r LEFT JOIN theme_lexicon l ON contains(r.theme, l.theme) GROUP BY r.agent, r.theme_pos, r.priority)"""
SCORES_SQL = f"""ps AS (SELECT fp.agent, p.pillar_ord, p.pillar,
      cast(sum(CASE WHEN fp.po = p.pillar_ord THEN CASE fp.priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END
               ELSE 0 END) AS bigint) AS score
    FROM fp CROSS JOIN {PILLARS_SQL} p GROUP BY fp.agent, p.pillar_ord, p.pillar)"""
DEMAND_SQL = """pd AS (SELECT pillar_ord, pillar, cast(count(*) AS bigint) AS n FROM (
      SELECT DISTINCT r.agent, r.theme_pos, l.pillar_ord, l.pillar FROM theme_rows r
      JOIN theme_lexicon l ON contains(lower(r.theme), lower(l.theme))) GROUP BY pillar_ord, pillar)"""
TOPK_AGENTS_SQL = """tk AS (SELECT pillar_ord, pillar, agent, score, cast(rank AS int) AS rank,
      round(score * 100.0 / max(score) OVER (PARTITION BY pillar_ord), 6) AS pct
    FROM (SELECT *, row_number() OVER (PARTITION BY pillar_ord ORDER BY score DESC, agent) AS rank FROM ps)
    WHERE rank <= 5 AND score > 0)"""
AGENT_COUNTS_SQL = """ac AS (SELECT agent, cast(count(*) AS bigint) AS n_themes,
      cast(sum(CASE WHEN priority = 'high' THEN 1 ELSE 0 END) AS bigint) AS n_high,
      cast(sum(CASE WHEN priority = 'medium' THEN 1 ELSE 0 END) AS bigint) AS n_medium
    FROM theme_rows GROUP BY agent)"""


def _theme_sql(*ctes: str) -> str:
    return THC.rstrip("\n") + ",\n" + ",\n".join(ctes) + "\n"


TOP_THEMES_SQL = """SELECT theme, n, cast(rank AS int) AS rank FROM (
    SELECT theme, cast(count(*) AS bigint) AS n, row_number() OVER (ORDER BY count(*) DESC, theme) AS rank
    FROM theme_rows GROUP BY theme) WHERE rank <= {k}"""

register(
    "theme_counts",
    THC + """SELECT theme, cast(count(*) AS bigint) AS n,
      round(cast(count(*) AS double) * 100.0 / (SELECT count(DISTINCT agent) FROM theme_rows), 6) AS pct
    FROM theme_rows GROUP BY theme""",
)(lambda spark, sf: H.theme_counts(theme_rows(spark, sf)))

register(
    "priority_dist",
    THC + """SELECT cast(sum(CASE WHEN priority = 'high' THEN 1 ELSE 0 END) AS bigint) AS high,
      cast(sum(CASE WHEN priority = 'medium' THEN 1 ELSE 0 END) AS bigint) AS medium,
      cast(sum(CASE WHEN priority = 'low' THEN 1 ELSE 0 END) AS bigint) AS low FROM theme_rows""",
)(lambda spark, sf: H.priority_dist(theme_rows(spark, sf)))

register("top_themes", THC + TOP_THEMES_SQL.format(k=5))(lambda spark, sf: H.top_themes(theme_rows(spark, sf), 5))

register(
    "theme_bars",
    THC + f"""SELECT theme, n, rank, round(n * 100.0 / max(n) OVER (), 6) AS pct FROM ({TOP_THEMES_SQL.format(k=8)})""",
)(lambda spark, sf: H.theme_bars(theme_rows(spark, sf), 8))

register("pillar_demand", _theme_sql(DEMAND_SQL) + "SELECT pillar_ord, pillar, n FROM pd WHERE n > 0")(
    lambda spark, sf: H.pillar_demand(theme_rows(spark, sf))
)

register(
    "top_pillar",
    _theme_sql(DEMAND_SQL)
    + """SELECT coalesce((SELECT pillar FROM pd ORDER BY n DESC, pillar_ord LIMIT 1), 'Connection') AS top_pillar,
      coalesce((SELECT n FROM pd ORDER BY n DESC, pillar_ord LIMIT 1), 0) AS top_pillar_n""",
)(lambda spark, sf: H.top_pillar(theme_rows(spark, sf)))

register("pillar_scores", _theme_sql(FIRST_PILLAR_SQL, SCORES_SQL) + "SELECT agent, pillar_ord, pillar, score FROM ps")(
    lambda spark, sf: H.pillar_scores(theme_rows(spark, sf))
)

register(
    "pillar_agent_counts",
    _theme_sql(FIRST_PILLAR_SQL, SCORES_SQL)
    + """SELECT pillar_ord, pillar, cast(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS bigint) AS n_agents
    FROM ps GROUP BY pillar_ord, pillar""",
)(lambda spark, sf: H.pillar_agent_counts(theme_rows(spark, sf)))

register(
    "pillar_top_agents",
    _theme_sql(FIRST_PILLAR_SQL, SCORES_SQL, TOPK_AGENTS_SQL) + "SELECT * FROM tk",
)(lambda spark, sf: H.pillar_top_agents(theme_rows(spark, sf), 5))

register(
    "pillar_cards",
    _theme_sql(FIRST_PILLAR_SQL, SCORES_SQL, TOPK_AGENTS_SQL)
    + """, rel AS (SELECT DISTINCT r.agent, r.theme_pos, r.theme, l.pillar_ord FROM theme_rows r
          JOIN theme_lexicon l ON contains(r.theme, l.theme)),
      rr AS (SELECT *, row_number() OVER (PARTITION BY pillar_ord, agent ORDER BY theme_pos) AS rn FROM rel),
      cards AS (SELECT pillar_ord, agent,
          string_agg(CASE WHEN rn <= 2 THEN theme END, ', ' ORDER BY theme_pos) AS first2, count(*) AS n_rel
        FROM rr GROUP BY pillar_ord, agent)
    SELECT tk.pillar, tk.agent, tk.rank, tk.score, tk.pct,
      coalesce(c.first2 || CASE WHEN c.n_rel > 2 THEN ' +' || cast(c.n_rel - 2 AS varchar) ELSE '' END, '') AS themes_text
    FROM tk LEFT JOIN cards c ON c.pillar_ord = tk.pillar_ord AND c.agent = tk.agent""",
)(lambda spark, sf: H.pillar_cards(theme_rows(spark, sf), 5))

RANKING_SQL = """rk AS (SELECT agent, n_high, n_medium,
      cast(row_number() OVER (ORDER BY n_high DESC, n_medium DESC, agent) AS bigint) AS rank FROM ac)"""
register(
    "agent_ranking",
    _theme_sql(AGENT_COUNTS_SQL, RANKING_SQL)
    + """SELECT agent, n_high, n_medium, rank, cast(floor((rank - 1) / 20) + 1 AS bigint) AS page,
      cast(ceil((SELECT count(*) FROM ac) / 20.0) AS bigint) AS total_pages FROM rk""",
)(lambda spark, sf: H.agent_ranking(theme_rows(spark, sf)))

register(
    "first_theme",
    THC + """SELECT agent, coalesce(theme, 'N/A') AS top_theme, coalesce(priority, 'low') AS top_priority
    FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY theme_pos) AS rn FROM theme_rows) WHERE rn = 1""",
)(lambda spark, sf: H.first_theme(theme_rows(spark, sf)))

register(
    "agent_needs",
    THC + """SELECT agent, theme_pos, theme, priority, recommendation, cast(need_rank AS int) AS need_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY agent ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2
        ELSE 3 END, theme_pos) AS need_rank FROM theme_rows) WHERE need_rank <= 3""",
)(lambda spark, sf: H.agent_needs(theme_rows(spark, sf), 3))

register(
    "profile_themes",
    THC + f"""SELECT agent, theme_pos, theme, upper(priority) AS priority_label, recommendation
    FROM theme_rows WHERE theme_pos < 3""",
)(lambda spark, sf: H.profile_themes(theme_rows(spark, sf)))

register(
    "context_block",
    THC + f"""SELECT agent, cast(count(*) AS bigint) AS n_themes,
      chr(10) || agent || ': ' || cast(count(*) AS varchar) || ' themes' || chr(10) ||
      coalesce(string_agg(CASE WHEN theme_pos < 2 THEN '  - ' || theme || ' (' || priority || '): ' ||
        recommendation || '...' || chr(10) END, '' ORDER BY theme_pos), '') AS block
    FROM theme_rows GROUP BY agent""",
)(lambda spark, sf: H.context_block(theme_rows(spark, sf)))

register(
    "theme_card_text",
    THC + """SELECT agent, theme_pos, theme, priority, frequency, array_to_string(examples[1:2], ' | ') AS examples_text
    FROM theme_rows""",
)(lambda spark, sf: H.theme_card_text(theme_rows(spark, sf)))

register(
    "report_header",
    BOTH + """SELECT (SELECT cast(count(DISTINCT call_id) AS bigint) FROM turns) AS total_calls,
      (SELECT cast(count(DISTINCT agent) AS bigint) FROM theme_rows) AS total_agents,
      (SELECT cast(count(*) AS bigint) FROM theme_rows) AS total_themes,
      (SELECT round(avg(sentiment_score), 6) FROM turns) AS avg_sentiment,
      (SELECT CASE WHEN avg(sentiment_score) > 0 THEN printf('%.2f', avg(sentiment_score))
         ELSE 'N/A' END FROM turns) AS avg_sentiment_text""",
)(lambda spark, sf: H.report_header(counted_turns(spark, sf), theme_rows(spark, sf)))

EXEC_CTES = BOTH.rstrip("\n") + ",\n" + ",\n".join([DEMAND_SQL, AGENT_COUNTS_SQL]) + "\n"
EXEC_SQL = f"""SELECT (SELECT cast(count(DISTINCT call_id) AS bigint) FROM turns) AS total_calls,
      (SELECT cast(count(*) AS bigint) FROM ac) AS total_agents,
      (SELECT round(avg(sentiment_score), 6) FROM turns) AS avg_sentiment,
      (SELECT cast(count(*) FILTER (WHERE priority = 'high') AS bigint) FROM theme_rows) AS high_themes,
      (SELECT cast(count(*) FILTER (WHERE priority = 'medium') AS bigint) FROM theme_rows) AS medium_themes,
      (SELECT cast(count(*) FILTER (WHERE priority = 'low') AS bigint) FROM theme_rows) AS low_themes,
      (SELECT string_agg(theme || ' (' || cast(n AS varchar) || ' agents)', ', ' ORDER BY rank)
         FROM ({TOP_THEMES_SQL.format(k=3)})) AS top_themes_text,
      (SELECT coalesce(max(theme), '') FROM ({TOP_THEMES_SQL.format(k=3)}) WHERE rank = 1) AS focus_theme,
      coalesce((SELECT pillar FROM pd ORDER BY n DESC, pillar_ord LIMIT 1), 'Connection') AS top_pillar,
      coalesce((SELECT n FROM pd ORDER BY n DESC, pillar_ord LIMIT 1), 0) AS top_pillar_n,
      (SELECT cast(count(*) FILTER (WHERE n_themes < 2) AS bigint) FROM ac) AS high_performers,
      (SELECT cast(count(*) FILTER (WHERE n_themes >= 2 AND n_themes < 4) AS bigint) FROM ac) AS moderate,
      (SELECT cast(count(*) FILTER (WHERE n_themes >= 4) AS bigint) FROM ac) AS priority_coaching"""
register("exec_summary", EXEC_CTES + EXEC_SQL)(lambda spark, sf: H.exec_summary(counted_turns(spark, sf), theme_rows(spark, sf)))

# -- request building (F1 review turns) -----------------------------------

from callsight.operators import requests as R  # noqa: E402
from callsight.operators import responses as V  # noqa: E402
from callsight.operators import exports as E  # noqa: E402
from callsight.sources.csvlines import read_csv_lines  # noqa: E402

MODEL = "test-model"
RUN_STAMP = "2025-02-07T13:00:00"


_TURN_TABLES: dict[tuple[str, ...], str] = {}
when_removed(_TURN_TABLES.clear)


def stored_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The turn table, parsed and written to the shared scratch folder once per session and dataset, then read."""
    key = _input_key(spark, sf, "conversations")
    if key not in _TURN_TABLES:
        path = scratch_path(spark, "turns")
        P.register_turns(turns(spark, sf), path)
        _TURN_TABLES[key] = path
    return spark.read.parquet(_TURN_TABLES[key])


def _review(spark: SparkSession, sf: str):
    t = stored_turns(spark, sf)
    sel = S.review_calls(t, MIN_CALLS, 5)  # ≤ 5 rows per agent
    return S.selected_turns(t, sel), sel


def heads(spark: SparkSession, sf: str) -> DataFrame:
    """Each call's turn count and first messages, parsed in one scan, written, and read by every step of a digest."""
    path = scratch_path(spark, "heads")
    P.call_heads(calls(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


def _digests_of(h: DataFrame, min_calls: int, previous_agents: DataFrame | None = None) -> DataFrame:
    return R.digest_of_heads(h, S.review_heads(h, min_calls, 5, previous_agents))  # ≤ 5 calls per agent


def _digests(spark: SparkSession, sf: str):
    return _digests_of(heads(spark, sf), MIN_CALLS)


SCOPED_SQL = f"""scoped AS (SELECT * FROM turns WHERE agent IN (SELECT agent FROM ({AGENT_CALLS_SQL}) WHERE n_calls >= {MIN_CALLS})),
  sel AS ({WORST_CALLS_SQL.replace("FROM turns", "FROM scoped")}),
  rt AS (SELECT * FROM scoped WHERE (agent, call_id) IN (SELECT (agent, call_id) FROM sel))"""

DIGEST_SQL = """,
  fm AS (SELECT *, {short} AS short
         FROM (SELECT *, row_number() OVER (PARTITION BY agent, call_id, speaker ORDER BY turn_idx) AS rn FROM rt
               WHERE speaker IN ('agent', 'customer')) WHERE rn <= 3),
  sides AS (SELECT agent, call_id,
      string_agg(CASE WHEN speaker = 'customer' THEN short END, ' | ' ORDER BY rn) AS cust,
      string_agg(CASE WHEN speaker = 'agent' THEN short END, ' | ' ORDER BY rn) AS agt
    FROM fm GROUP BY agent, call_id),
  means AS (SELECT agent, call_id, avg(sentiment_score) AS m FROM rt GROUP BY agent, call_id),
  ords AS (SELECT agent, call_id, cast(row_number() OVER (PARTITION BY agent ORDER BY call_id) AS int) AS call_no FROM sel)
SELECT o.agent, o.call_id, o.call_no,
  'Call ' || cast(o.call_no AS varchar) || ':' ||
  CASE WHEN m.m IS NOT NULL AND m.m <> 0 THEN ' [Sentiment: ' || printf('%.2f', m.m) || ']' ELSE '' END ||
  chr(10) || '- {cust_label}: ' || coalesce(s.cust, '') || chr(10) || '- {agent_label}: ' || coalesce(s.agt, '') AS digest
FROM ords o LEFT JOIN means m ON m.agent = o.agent AND m.call_id = o.call_id
  LEFT JOIN sides s ON s.agent = o.agent AND s.call_id = o.call_id"""

register(
    "call_digest",
    TC.rstrip("\n") + ",\n" + SCOPED_SQL
    + DIGEST_SQL.format(
        short="CASE WHEN length(message) > 100 THEN substr(message, 1, 100) || '...' ELSE message END",
        cust_label="Customer",
        agent_label="Agent",
    ),
)(_digests)

WIDE_SQL = """sel AS (SELECT agent, call_id FROM (
      SELECT agent, call_id, row_number() OVER (PARTITION BY agent ORDER BY call_id) AS rn
      FROM (SELECT DISTINCT agent, call_id FROM turns WHERE agent IS NOT NULL)) WHERE rn <= 10),
  rt AS (SELECT * FROM turns WHERE (agent, call_id) IN (SELECT (agent, call_id) FROM sel))"""

register(
    "call_digest_wide",
    TC.rstrip("\n") + ",\n" + WIDE_SQL.replace("WHERE rn <= 10", "")
    + DIGEST_SQL.format(short="message", cust_label="Customer issues", agent_label="Agent responses"),
)(lambda spark, sf: R.call_digest_wide(heads(spark, sf)))


def _digest_ctes(head: str, short: str, cust_label: str, agent_label: str) -> str:
    """The digest query with its final select as a CTE ``dg`` (agent, call_id, call_no, digest)."""
    body = DIGEST_SQL.format(short=short, cust_label=cust_label, agent_label=agent_label)
    marker = "\nSELECT o.agent, o.call_id, o.call_no,"
    assert marker in body
    return head + body.replace(marker, ",\n  dg AS (SELECT o.agent, o.call_id, o.call_no,") + ")"


def _prompt_select(legacy: bool, n_calls_sql: str, extra_from: str = "", group: str = "dg.agent") -> str:
    from callsight.operators.themes import DEFAULT_THEMES

    themes = ", ".join(DEFAULT_THEMES)
    exprs = {
        "themes": O.quote_sql(themes),
        "agent": "dg.agent",
        "n_calls": f"cast({n_calls_sql} AS varchar)",
        "digests": "string_agg(dg.digest, chr(10) ORDER BY dg.call_no)",
    }
    sys_t = R.LEGACY_SYSTEM_PROMPT_TEMPLATE if legacy else R.SYSTEM_PROMPT_TEMPLATE
    usr_t = R.LEGACY_USER_PROMPT_TEMPLATE if legacy else R.USER_PROMPT_TEMPLATE
    return f"""SELECT dg.agent AS agent, cast({n_calls_sql} AS bigint) AS n_calls,
  {O.text_template(sys_t, exprs)} AS system_prompt,
  {O.text_template(usr_t, exprs)} AS user_prompt
FROM dg {extra_from} GROUP BY {group}"""


PROMPT_DIGESTS_SQL = _digest_ctes(
    TC.rstrip("\n") + ",\n" + SCOPED_SQL,
    "CASE WHEN length(message) > 100 THEN substr(message, 1, 100) || '...' ELSE message END",
    "Customer",
    "Agent",
)
PROMPTS_SQL = PROMPT_DIGESTS_SQL + "\n" + _prompt_select(False, "count(*)")
PART_SQL = "cast((dg.call_no - 1) // 10 + 1 AS int)"
WIDE_PROMPTS_SQL = (
    _digest_ctes(TC.rstrip("\n") + ",\n" + WIDE_SQL.replace("WHERE rn <= 10", ""), "message", "Customer issues", "Agent responses")
    + f",\n  cc AS ({AGENT_CALLS_SQL})\n"
    + _prompt_select(True, "cc.n_calls", "JOIN cc ON cc.agent = dg.agent", f"dg.agent, {PART_SQL}, cc.n_calls").replace(
        "SELECT dg.agent AS agent", f"SELECT dg.agent AS agent, {PART_SQL} AS part"
    )
)
REQUESTS_SQL = (
    PROMPT_DIGESTS_SQL
    + ",\n  pr AS ("
    + _prompt_select(False, "count(*)")
    + f""")
SELECT agent, cast(floor((row_number() OVER (ORDER BY agent) - 1) / 20) + 1 AS bigint) AS batch_no,
  to_json({{'model': '{MODEL}', 'messages': [{{'role': 'system', 'content': system_prompt}}, {{'role': 'user', 'content': user_prompt}}],
    'temperature': cast(0.3 AS double), 'max_tokens': 2000, 'response_format': {{'type': 'json_object'}}}})::varchar AS payload
FROM pr"""
)


@register("agent_prompt_wide", WIDE_PROMPTS_SQL)
def _prompts_wide(spark: SparkSession, sf: str):
    from callsight.operators.themes import DEFAULT_THEMES

    h = heads(spark, sf)
    return R.agent_prompts(R.call_digest_wide(h), DEFAULT_THEMES, legacy=True, n_calls=A.agent_call_counts(h), per_prompt=R.LEGACY_CALLS_PER_PROMPT)


def _prompts(spark: SparkSession, sf: str):
    from callsight.operators.themes import DEFAULT_THEMES

    return R.agent_prompts(_digests(spark, sf), DEFAULT_THEMES)


register("agent_prompt", PROMPTS_SQL)(_prompts)


@register("request_rows", REQUESTS_SQL)
def _request_rows(spark: SparkSession, sf: str):
    p = _prompts(spark, sf)
    return R.request_rows(p, S.agent_batches(p.select("agent"), 20), MODEL)


register(
    "agent_batches",
    THC + """SELECT agent, cast(row_number() OVER (ORDER BY agent) AS bigint) AS agent_ordinal,
      cast(floor((row_number() OVER (ORDER BY agent) - 1) / 20) + 1 AS bigint) AS batch_no
    FROM (SELECT DISTINCT agent FROM theme_rows)""",
)(lambda spark, sf: S.agent_batches(theme_rows(spark, sf), 20))

# -- responses (F3 insights serialised into damaged envelopes) ---------------


def run_agents(spark: SparkSession, sf: str) -> DataFrame:
    """Every agent of the run with its calls that went to review (F4): agents with themes, and those of the calls from
    number 100 on under names that have none."""
    number = F.expr("cast(substring(agent, 7) AS bigint)")
    name = F.when(number < 100, F.concat(F.lit("Agent "), pad_left(number, 5))).otherwise(F.concat(F.lit("Quiet "), pad_left(number, 5)))
    reviewed = S.calls_analyzed(S.review_calls(counted_turns(spark, sf), 1, 5)).select(name.alias("agent"), "calls_analyzed")
    named = theme_rows(spark, sf).select("agent").distinct().join(reviewed, "agent", "full_outer")
    return named.select("agent", F.coalesce("calls_analyzed", F.lit(0).cast("bigint")).alias("calls_analyzed"))


RUN_AGENTS_SQL = f"""rc AS (SELECT CASE WHEN cast(no AS bigint) < 100 THEN 'Agent ' ELSE 'Quiet ' END || lpad(no, cast(greatest(5, length(no)) AS int), '0') AS agent, n
    FROM (SELECT cast(cast(substr(agent, 7) AS bigint) AS varchar) AS no, count(*) AS n FROM ({WORST_CALLS_SQL}) GROUP BY ALL)),
  ra AS (SELECT agent, cast(coalesce(max(n), 0) AS bigint) AS calls FROM
    (SELECT agent, n FROM rc UNION ALL SELECT DISTINCT agent, NULL FROM theme_rows) GROUP BY agent)"""
BOTH_RUN = BOTH.rstrip("\n") + ",\n" + RUN_AGENTS_SQL


def _responses(spark: SparkSession, sf: str):
    # Python's json keeps the last duplicate key; VARIANT does with this flag.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Responses arrive from outside the job (the model service); land them as a table first.
    if (there := _landed(spark, sf, "responses")) is not None:
        return there
    path = scratch_path(spark, "responses")
    X.responses_from_theme_rows(theme_rows(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


CLASS_SQL = "cast(substr(agent, 7) AS bigint) % 8"
register(
    "response_errors",
    THC + f"""SELECT agent, CASE {CLASS_SQL} WHEN 2 THEN 'error' WHEN 3 THEN 'no_choices' WHEN 4 THEN 'bad_json'
      WHEN 5 THEN 'empty' WHEN 7 THEN 'no_response' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT agent FROM theme_rows)""",
)(lambda spark, sf: V.response_errors(_responses(spark, sf)))

register(
    "validated_themes",
    THC + f"""SELECT agent, theme_pos, theme,
      CASE WHEN {CLASS_SQL} = 6 THEN 'low' ELSE priority END AS priority,
      CASE WHEN {CLASS_SQL} = 6 THEN cast(0 AS bigint) ELSE frequency END AS frequency,
      examples, recommendation
    FROM theme_rows WHERE {CLASS_SQL} IN (0, 1, 6)""",
)(lambda spark, sf: V.validated_theme_rows(_responses(spark, sf)))

register(
    "validated_strengths",
    THC + f"""SELECT agent, ['Strength ' || cast(cast(substr(agent, 7) AS bigint) % 3 AS varchar)] AS strengths
    FROM (SELECT DISTINCT agent FROM theme_rows) WHERE {CLASS_SQL} IN (0, 1, 6)""",
)(lambda spark, sf: V.validated_strengths(_responses(spark, sf)))


@register(
    "merge_insights",
    # New rows carry the validated themes and one strength; agents without a usable response keep their old rows,
    # whose only theme and strengths name the old run.
    THC + f"""SELECT agent, to_json(list({{'theme': theme, 'priority': CASE WHEN {CLASS_SQL} = 6 THEN 'low' ELSE priority END,
            'frequency': CASE WHEN {CLASS_SQL} = 6 THEN cast(0 AS bigint) ELSE frequency END,
            'examples': examples, 'recommendation': recommendation}} ORDER BY theme_pos))::varchar AS coaching_themes,
      ['Strength ' || cast({O.AGENT_NO} % 3 AS varchar)] AS strengths
    FROM theme_rows WHERE {CLASS_SQL} IN (0, 1, 6) GROUP BY agent
    UNION ALL SELECT DISTINCT agent, '[{{"theme":"old theme","priority":"low","frequency":1,"examples":[],"recommendation":""}}]', ['old run']
    FROM theme_rows WHERE {CLASS_SQL} NOT IN (0, 1, 6) AND {O.AGENT_NO} % 2 = 0""",
)
def _merge(spark: SparkSession, sf: str):
    responses = _responses(spark, sf)
    no_examples = F.array().cast("array<string>")
    theme = F.struct(F.lit("old theme").alias("theme"), F.lit("low").alias("priority"), F.lit(1).cast("bigint").alias("frequency"),
                     no_examples.alias("examples"), F.lit("").alias("recommendation"))
    even = responses.where(X.agent_number() % 2 == 0).select("agent")
    old = even.select("agent", F.array(theme).alias("coaching_themes"), F.array(F.lit("old run")).alias("strengths"))
    merged = V.merge_insights(old, V.validate_insights(responses))
    return merged.select("agent", F.to_json("coaching_themes").alias("coaching_themes"), "strengths")


register(
    "agent_segments",
    BOTH_RUN + """ SELECT s.segment, cast(count(c.agent) AS bigint) AS n_agents
    FROM (VALUES ('High Performer'), ('Moderate Development'), ('Priority Coaching')) s(segment)
    LEFT JOIN (SELECT ra.agent, count(theme) AS n FROM ra LEFT JOIN theme_rows r ON r.agent = ra.agent GROUP BY ra.agent) c
      ON s.segment = CASE WHEN n >= 4 THEN 'Priority Coaching' WHEN n >= 2 THEN 'Moderate Development' ELSE 'High Performer' END
    GROUP BY s.segment""",
)(lambda spark, sf: H.agent_segments(theme_rows(spark, sf), run_agents(spark, sf)))

register(
    "agent_summary_rows",
    BOTH_RUN + """, c AS (SELECT ra.agent, ra.calls, count(*) FILTER (WHERE priority = 'high') AS n_high,
        count(*) FILTER (WHERE priority = 'medium') AS n_medium, coalesce(arg_min(theme, theme_pos), 'N/A') AS top_theme,
        coalesce(arg_min(priority, theme_pos), 'low') AS top_priority
      FROM ra LEFT JOIN theme_rows r ON r.agent = ra.agent GROUP BY ra.agent, ra.calls),
    rk AS (SELECT *, cast(row_number() OVER (ORDER BY n_high DESC, n_medium DESC, agent) AS bigint) AS rank FROM c)
    SELECT agent, rank, cast(floor((rank - 1) / 20) + 1 AS bigint) AS page, calls, top_theme, top_priority,
      upper(substr(agent, 1, 1)) AS initial FROM rk""",
)(lambda spark, sf: H.agent_summary_rows(theme_rows(spark, sf), run_agents(spark, sf)))

# -- exports -------------------------------------------------------------------

register(
    "coaching_cache",
    THC + f"""SELECT agent, theme, priority, frequency, to_json(examples)::varchar AS examples, recommendation,
      '{RUN_STAMP}' AS processed_at, '{MODEL}' AS model_used FROM theme_rows""",
)(lambda spark, sf: E.coaching_cache(theme_rows(spark, sf), RUN_STAMP, MODEL))



@register(
    "cache_table",
    THC + f"""SELECT agent, theme, priority, frequency, to_json(examples)::varchar AS examples, recommendation,
      '{RUN_STAMP}' AS processed_at, '{MODEL}' AS model_used FROM theme_rows WHERE {O.AGENT_NO} % 2 = 1""",
)
def _cache_table(spark: SparkSession, sf: str):
    """The stored cache after a second run replaced the first one's rows."""
    path, tr = scratch_path(spark, "coaching-cache"), theme_rows(spark, sf)
    E.write_cache(E.coaching_cache(tr, "2025-02-07T12:00:00", MODEL), path)
    E.write_cache(E.coaching_cache(tr.where(X.agent_number() % 2 == 1), RUN_STAMP, MODEL), path)
    return E.read_cache(spark, path)


register(
    "export_theme_rows",
    THC + "SELECT agent, theme, priority, frequency, array_to_string(examples, ' | ') AS examples, recommendation FROM theme_rows",
)(lambda spark, sf: E.export_theme_rows(theme_rows(spark, sf)))

register(
    "export_summary",
    BOTH_RUN + """ SELECT ra.agent, ra.calls, cast(count(theme) AS bigint) AS coaching_themes,
      cast(count(*) FILTER (WHERE priority = 'high') AS bigint) AS high_priority
    FROM ra LEFT JOIN theme_rows r ON r.agent = ra.agent GROUP BY ra.agent, ra.calls""",
)(lambda spark, sf: E.export_summary(theme_rows(spark, sf), run_agents(spark, sf)))

register(
    "export_details", THC + "SELECT agent, theme, priority, frequency, recommendation FROM theme_rows"
)(lambda spark, sf: E.export_details(theme_rows(spark, sf)))

# -- questions ---------------------------------------------------------------

from callsight.operators import questions as Q  # noqa: E402

QUESTIONS_SQL = """qs AS (SELECT cast(substr(agent, 7) AS bigint) AS question_id,
    CASE cast(substr(agent, 7) AS bigint) % 8 WHEN 0 THEN 'What are the top themes?'
      WHEN 1 THEN 'How should ' || agent || ' improve?' WHEN 2 THEN 'How many calls are there?'
      WHEN 3 THEN 'How many agents are there?' WHEN 4 THEN 'What is the average sentiment?'
      WHEN 5 THEN 'List all supervisors' WHEN 6 THEN 'Why did Monday go badly?'
      ELSE 'Which coaching theme fits ' || lower(agent) || ' best?' END AS question,
    CASE cast(substr(agent, 7) AS bigint) % 8 WHEN 0 THEN 'top_themes' WHEN 1 THEN 'agent_needs' WHEN 2 THEN 'count_calls'
      WHEN 3 THEN 'count_agents' WHEN 4 THEN 'avg_sentiment' WHEN 5 THEN 'help' WHEN 6 THEN 'llm' ELSE 'agent_needs' END AS route,
    CASE WHEN cast(substr(agent, 7) AS bigint) % 8 IN (1, 7) THEN agent END AS agent
  FROM (SELECT DISTINCT agent FROM theme_rows))"""


def _questions(spark: SparkSession, sf: str):
    return X.questions_from_agents(theme_rows(spark, sf))


@register("question_intent", _theme_sql(QUESTIONS_SQL) + "SELECT question_id, question, route, agent FROM qs")
def _route(spark: SparkSession, sf: str):
    tr = theme_rows(spark, sf)
    has = tr.agg((F.count(F.lit(1)) > 0).alias("has_coaching"))
    return Q.route_questions(_questions(spark, sf), tr.select("agent").distinct(), has)


register(
    "agent_mentions",
    _theme_sql(QUESTIONS_SQL) + "SELECT question_id, agent FROM qs WHERE agent IS NOT NULL",
)(lambda spark, sf: Q.agent_mentions(_questions(spark, sf), theme_rows(spark, sf).select("agent").distinct()))

register(
    "answer_questions",
    BOTH.rstrip("\n") + ",\n" + QUESTIONS_SQL + f""",
  needs AS (SELECT agent, '**Coaching needs for ' || agent || ':**' || chr(10) ||
      string_agg('- **' || theme || '** (' || priority || ' priority): ' || recommendation, chr(10) ORDER BY need_rank) AS a
    FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY CASE priority WHEN 'high' THEN 1
            WHEN 'medium' THEN 2 ELSE 3 END, theme_pos) AS need_rank FROM theme_rows) WHERE need_rank <= 3 GROUP BY agent),
  top AS (SELECT '**Top coaching themes:**' || chr(10) ||
      string_agg('- ' || theme || ': ' || cast(n AS varchar) || ' agents', chr(10) ORDER BY rank) AS a
    FROM ({TOP_THEMES_SQL.format(k=5)}))
SELECT qs.question_id, qs.question, qs.route, qs.agent,
  CASE qs.route WHEN 'top_themes' THEN (SELECT a FROM top) WHEN 'agent_needs' THEN needs.a
    WHEN 'count_calls' THEN 'There are ' || (SELECT cast(count(DISTINCT call_id) AS varchar) FROM turns) || ' calls in the dataset.'
    WHEN 'count_agents' THEN 'There are ' || (SELECT cast(count(DISTINCT agent) AS varchar) FROM turns) || ' agents in the dataset.'
    WHEN 'avg_sentiment' THEN (SELECT CASE WHEN avg(sentiment_score) IS NULL THEN 'Sentiment data not available in the transcripts.'
      ELSE printf('The average sentiment score is %.2f.', avg(sentiment_score)) END FROM turns)
    WHEN 'help' THEN 'I can answer questions about call counts, agent counts, and sentiment averages. Try rephrasing!'
  END AS answer
FROM qs LEFT JOIN needs ON needs.agent = qs.agent""",
)(lambda spark, sf: Q.answer_questions(_questions(spark, sf), counted_turns(spark, sf), theme_rows(spark, sf)))


def quiet_agents(spark: SparkSession, sf: str) -> DataFrame:
    """Agents of the run that have no theme: those of the calls, under names that no theme row has."""
    agents = counted_turns(spark, sf).where(F.col("agent").isNotNull()).select("agent").distinct()
    return agents.select(F.concat(F.lit("Quiet "), "agent").alias("agent"), F.substring("agent", 7, 12).cast("bigint").alias("no"))


@register(
    "answer_questions_quiet",
    # Coaching questions about agents without themes: routed to them, with an empty list of needs.
    TC + """SELECT 1000000 + no AS question_id, 'Any coaching for quiet ' || lower(agent) || '?' AS question, 'agent_needs' AS route,
      'Quiet ' || agent AS agent, '**Coaching needs for Quiet ' || agent || ':**' || chr(10) AS answer
    FROM (SELECT DISTINCT agent, cast(substr(agent, 7) AS bigint) AS no FROM turns WHERE agent IS NOT NULL)
    UNION ALL SELECT 2000000 + no, 'List all of Quiet ' || agent || ', total', 'help', NULL,
      'I can answer questions about call counts, agent counts, and sentiment averages. Try rephrasing!'
    FROM (SELECT DISTINCT agent, cast(substr(agent, 7) AS bigint) AS no FROM turns WHERE agent IS NOT NULL)""",
)
def _quiet(spark: SparkSession, sf: str):
    quiet = quiet_agents(spark, sf)
    asked = [
        quiet.select((F.col("no") + 1_000_000).alias("question_id"), F.concat(F.lit("Any coaching for "), F.lower("agent"), F.lit("?")).alias("question")),
        quiet.select((F.col("no") + 2_000_000).alias("question_id"), F.concat(F.lit("List all of "), "agent", F.lit(", total")).alias("question")),
    ]
    return Q.answer_questions(asked[0].unionByName(asked[1]), counted_turns(spark, sf), theme_rows(spark, sf), quiet.select("agent"))


# -- sessions ------------------------------------------------------------------

from callsight.operators import sessions as K  # noqa: E402

FP_SQL = """SELECT substr(md5(concat_ws(',', 'call_id,agent,turn_idx,timestamp,speaker,message,sentiment_score',
      cast(count(*) AS varchar), cast(coalesce(sum(h), 0) AS varchar), cast(coalesce(bit_xor(h), 0) AS varchar))), 1, 12) AS file_hash
  FROM (SELECT cast('0x' || substr(md5(concat_ws(',', {f})), 1, 15) AS bigint) AS h FROM turns)"""
_FIELD = """CASE WHEN coalesce(cast({c} AS varchar), '') SIMILAR TO '.*[,"\\n\\r].*'
      THEN '"' || replace(coalesce(cast({c} AS varchar), ''), '"', '""') || '"' ELSE coalesce(cast({c} AS varchar), '') END"""
register(
    "dataset_fingerprint",
    TC + FP_SQL.format(
        f=", ".join(_FIELD.format(c=c) for c in ["call_id", "agent", "turn_idx", "timestamp", "speaker", "message", "sentiment_score"])
    ),
)(lambda spark, sf: K.dataset_fingerprint(turns(spark, sf)))

from callsight.operators import uploads as U  # noqa: E402

_FINGERPRINT_SQL = TC + FP_SQL.format(
    f=", ".join(_FIELD.format(c=c) for c in ["call_id", "agent", "turn_idx", "timestamp", "speaker", "message", "sentiment_score"])
)
UPLOADS = 3


def _uploads(spark: SparkSession, sf: str) -> str:
    """The turns loaded as uploads, one of them twice: each is read once, and its state kept."""
    path, t = scratch_path(spark, "uploads"), stored_turns(spark, sf)
    number = F.pmod(F.xxhash64("call_id"), F.lit(UPLOADS))
    for i in [*range(UPLOADS), 0]:
        U.add_upload(t.where(number == i), path, f"upload{i}")
    return path


register(
    "upload_counts",
    TC + "SELECT count(*) AS total_messages, count(DISTINCT call_id) AS total_calls, count(DISTINCT agent) AS total_agents FROM turns",
)(lambda spark, sf: U.estimated_counts(spark, _uploads(spark, sf)))  # estimates: exact for as few as the comparison has
register("upload_fingerprint", _FINGERPRINT_SQL)(lambda spark, sf: U.stored_fingerprint(spark, _uploads(spark, sf)))

TS_OLD, TS_NEW = "2025-02-07 12:00:00", "2025-02-07 13:00:00"


def _session_store(spark: SparkSession, sf: str):
    """Two sessions of the F3 insights: an older one (even agents) and a newer one (all).

    The fingerprint stays on the cluster: it is a one-value subquery in the writes and reads.
    """
    path = scratch_path(spark, "sessions")
    ins = X.insights_from_theme_rows(theme_rows(spark, sf))
    fh = one_value(K.dataset_fingerprint(turns(spark, sf)))
    K.save_session(ins.where(F.substring("agent", -1, 1).cast("int") % 2 == 0), path, fh, TS_OLD, MODEL, {"min_calls": "10"})
    K.save_session(ins, path, fh, TS_NEW, MODEL, {"min_calls": "10", "sentiment_priority": "True"})
    return path, fh


@register(
    "latest_session",
    THC + f"""SELECT agent, cast(count(*) AS bigint) AS n_themes, '{MODEL}' AS model_used FROM theme_rows GROUP BY agent""",
)
def _latest(spark: SparkSession, sf: str):
    path, fh = _session_store(spark, sf)
    s = K.latest_session(spark, path, fh)
    return s.select("agent", F.size("coaching_themes").cast("bigint").alias("n_themes"), "model_used")


@register(
    "list_sessions",
    THC + f"""SELECT * FROM (VALUES ('{TS_NEW}', '{MODEL}', (SELECT cast(count(DISTINCT agent) AS bigint) FROM theme_rows)),
      ('{TS_OLD}', '{MODEL}', (SELECT cast(count(DISTINCT agent) AS bigint) FROM theme_rows
         WHERE cast(right(agent, 1) AS int) % 2 = 0))) t(session_ts, model_used, n_agents)""",
)
def _list(spark: SparkSession, sf: str):
    path, _ = _session_store(spark, sf)
    ts = F.date_format("session_ts", "yyyy-MM-dd HH:mm:ss").alias("session_ts")
    return K.list_sessions(spark, path).select(ts, "model_used", "n_agents")


@register(
    "delete_session",
    THC + f"""SELECT '{TS_NEW}' AS session_ts, cast(count(DISTINCT agent) AS bigint) AS n_agents FROM theme_rows""",
)
def _delete(spark: SparkSession, sf: str):
    path, fh = _session_store(spark, sf)
    kept = K.delete_session(spark, path, fh, TS_OLD)
    ts = F.date_format("session_ts", "yyyy-MM-dd HH:mm:ss").alias("session_ts")
    return kept.groupBy(ts).agg(F.count(F.lit(1)).cast("bigint").alias("n_agents"))


@register(
    "incremental_review",
    # The stored session holds agents 0, 2, 4, 6; agents with at least two calls that it lacks are new, get two themes
    # each, and the merged session has the old agents' theme and the new agents' two.
    TC + f"""SELECT agent, CASE WHEN cast(substr(agent, 7) AS bigint) IN (0, 2, 4, 6) THEN 'stored' ELSE 'new' END AS origin,
      cast(CASE WHEN cast(substr(agent, 7) AS bigint) IN (0, 2, 4, 6) THEN 1 ELSE 2 END AS bigint) AS n_themes
    FROM ({AGENT_CALLS_SQL}) WHERE n_calls >= 2 OR cast(substr(agent, 7) AS bigint) IN (0, 2, 4, 6)""",
)
def _incremental(spark: SparkSession, sf: str):
    """Newest session → its agents → new agents → their requests → answers → validated → merged → saved → read again."""
    path, t = scratch_path(spark, "sessions"), stored_turns(spark, sf)
    fh = one_value(K.dataset_fingerprint(t))
    theme = lambda name: F.struct(F.lit(name).alias("theme"), F.lit("high").alias("priority"), F.lit(1).cast("bigint").alias("frequency"),
                                  F.array(F.lit('said "so"\n')).alias("examples"), F.lit("é").alias("recommendation"))
    agents = t.select("agent").where(F.col("agent").isNotNull()).distinct()
    stored = agents.where(X.agent_number().isin(0, 2, 4, 6))
    K.save_session(stored.select("agent", F.array(theme("old")).alias("coaching_themes"), F.array(F.lit("stored")).alias("strengths")), path, fh, TS_OLD, MODEL)

    session = K.latest_session(spark, path, fh)
    prompts = R.agent_prompts(_digests_of(heads(spark, sf), 2, K.previous_agents(session)), H.DEFAULT_THEMES)
    requests = R.request_rows(prompts, S.agent_batches(prompts.select("agent"), 20), MODEL)
    # The model's answers come from outside the job; here each request is answered with two themes.
    content = F.to_json(F.struct(F.array(theme("one"), theme("two")).alias("coaching_themes"), F.array(F.lit("new")).alias("strengths")))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    answered = V.attach_responses(requests, requests.select("agent", body.alias("response")))
    merged = V.merge_insights(session.select("agent", "coaching_themes", "strengths"), V.validate_insights(answered.select("agent", "response")))
    K.save_session(merged, path, fh, TS_NEW, MODEL)
    out = K.latest_session(spark, path, fh)
    return out.select("agent", F.col("strengths")[0].alias("origin"), F.size("coaching_themes").cast("bigint").alias("n_themes"))


register(
    "session_metadata",
    BOTH + f"""SELECT '{RUN_STAMP}' AS processed_at, '{MODEL}' AS model_used,
      (SELECT cast(count(DISTINCT call_id) AS bigint) FROM turns) AS total_calls,
      (SELECT cast(count(DISTINCT agent) AS bigint) FROM theme_rows) AS total_agents""",
)(lambda spark, sf: K.session_metadata(counted_turns(spark, sf), X.insights_from_theme_rows(theme_rows(spark, sf)), RUN_STAMP, MODEL))

INS_CTES = THC.rstrip("\n") + ",\n" + O.INSIGHTS.strip() + "\n"
register(
    "insights_json",
    INS_CTES + "SELECT agent, to_json({'coaching_themes': coaching_themes, 'strengths': strengths})::varchar AS insights_json FROM ins",
)(lambda spark, sf: K.insights_json(X.insights_from_theme_rows(theme_rows(spark, sf))))

# -- sources and sinks -----------------------------------------------------------

from callsight.sources import files as Y  # noqa: E402

CALLS_OUT_SQL = "SELECT call_id, agent, transcript, sentiment_score FROM calls"


@register("read_csv", TCC + CALLS_OUT_SQL)
def _read_csv(spark: SparkSession, sf: str):
    path = scratch_path(spark, "calls-csv")
    E.write_csv(calls(spark, sf), path)
    return Y.read_csv(spark, path, Y.CALLS_SCHEMA)


@register("read_csv_lines", TCC + CALLS_OUT_SQL)
def _read_csv_lines(spark: SparkSession, sf: str):
    """The same file, whose transcripts hold line breaks, read by as many tasks as it has splits."""
    path = scratch_path(spark, "calls-csv")
    E.write_csv(calls(spark, sf), path)
    return read_csv_lines(spark, path, Y.CALLS_SCHEMA)


@register("write_parquet", TC + "SELECT call_id, agent, turn_idx, timestamp, speaker, message, sentiment_score FROM turns")
def _write_parquet(spark: SparkSession, sf: str):
    path = scratch_path(spark, "turns-parquet")
    Y.write_parquet(turns(spark, sf), path)
    return Y.read_parquet(spark, path)


@register(
    "read_text_calls",
    TCC + """SELECT 'CALL_' || lpad(cast(row_number() OVER (ORDER BY call_id) AS varchar), cast(greatest(4, length(cast(row_number() OVER (ORDER BY call_id) AS varchar))) AS int), '0') AS call_id,
      'Unknown' AS agent, transcript || chr(10) AS transcript FROM calls""",
)
def _read_text(spark: SparkSession, sf: str):
    path = scratch_path(spark, "calls-text")
    Y.write_text_calls(calls(spark, sf), path)
    return Y.read_text_calls(spark, path)


@register(
    "union_files",
    TCC + """SELECT call_id, agent, transcript, sentiment_score FROM calls
      UNION ALL SELECT call_id, agent, transcript, NULL FROM calls""",
)
def _union(spark: SparkSession, sf: str):
    c = calls(spark, sf)
    path = scratch_path(spark, "calls-csv")
    E.write_csv(c.drop("sentiment_score"), path)
    return Y.union_files([c, Y.read_calls(spark, path + "/*.csv"), Y.read_calls(spark, path + ".xlsx")])


register(
    "map_columns",
    """SELECT cast(conv_id AS varchar) || '-' || cast(turn AS varchar) AS call_id, role AS agent, text AS transcript,
      cast(NULL AS double) AS sentiment_score FROM conversations""",
)(
    lambda spark, sf: Y.map_columns(
        X.read_table(spark, sf, "conversations").withColumn(
            "key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        ),
        "key",
        "role",
        "text",
        None,
    )
)


register(
    "map_columns_extra",
    # Columns that the mapping names besides the four come along as they are.
    """SELECT cast(conv_id AS varchar) || '-' || cast(turn AS varchar) AS call_id, role AS agent, text AS transcript,
      cast(turn AS double) AS sentiment_score, conv_id, role FROM conversations""",
)(
    lambda spark, sf: Y.map_columns(
        X.read_table(spark, sf, "conversations").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))),
        "key", "role", "text", "turn", passthrough=("conv_id", "role"),
    )
)


@register(
    "active_themes",
    _theme_sql("""cu AS (SELECT theme, min(agent || '#' || lpad(cast(theme_pos AS varchar), 3, '0')) AS k FROM theme_rows
        WHERE theme NOT IN (SELECT theme FROM theme_lexicon) GROUP BY theme)""")
    + """SELECT cast(theme_ord AS bigint) AS theme_ord, theme FROM theme_lexicon
    UNION ALL SELECT cast(29 + row_number() OVER (ORDER BY k) AS bigint), theme FROM cu""",
)
def _active(spark: SparkSession, sf: str):
    tr = theme_rows(spark, sf)
    lex = H.theme_lexicon(spark)
    custom = (
        tr.join(F.broadcast(lex.select("theme")), "theme", "left_anti")  # 30 fixed rows
        .groupBy("theme")
        .agg(F.min(F.concat(F.col("agent"), F.lit("#"), F.lpad(F.col("theme_pos").cast("string"), 3, "0"))).alias("line_no"))
        .select("line_no", F.col("theme").alias("line"))
    )
    return Y.active_themes(spark, "both", lex, custom)


# -- bulk redaction over documents -------------------------------------------------

from callsight.functions import text as TX  # noqa: E402

register(
    "redact_documents",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL_REDACTED]', 'g'),
      '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '[PHONE_REDACTED]', 'g'),
      '\b\d{3}-\d{2}-\d{4}\b', '[SSN_REDACTED]', 'g'),
      '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '[CARD_REDACTED]', 'g') AS text FROM documents""",
)(lambda spark, sf: X.read_table(spark, sf, "documents").select("doc_id", TX.redact_pii("text").alias("text")))

# -- streaming ---------------------------------------------------------------------

from callsight.streaming.turns import stream_turns  # noqa: E402


@register("stream_turns", TC + "SELECT call_id, agent, turn_idx, timestamp, speaker, message, sentiment_score FROM turns")
def _stream(spark: SparkSession, sf: str):
    src = scratch_path(spark, "calls-stream-in")
    Y.write_parquet(calls(spark, sf), src)
    return stream_turns(spark, src, scratch_path(spark, "turns-stream-out"), scratch_path(spark, "turns-stream-ckpt"))

# -- report texts ----------------------------------------------------------------

from callsight.operators import reports as RP  # noqa: E402

register(
    "analytics_context",
    BOTH.rstrip("\n") + f""",
  top3 AS ({TOP_THEMES_SQL.format(k=3)}),
  nums AS (SELECT (SELECT cast(count(DISTINCT agent) AS bigint) FROM theme_rows) AS total_agents,
      (SELECT cast(count(DISTINCT call_id) AS bigint) FROM turns) AS total_calls,
      (SELECT avg(sentiment_score) FROM turns) AS avg_s,
      (SELECT cast(count(*) FILTER (WHERE priority = 'high') AS bigint) FROM theme_rows) AS high_themes,
      (SELECT cast(count(*) FILTER (WHERE priority = 'medium') AS bigint) FROM theme_rows) AS medium_themes,
      (SELECT cast(count(*) FILTER (WHERE priority = 'low') AS bigint) FROM theme_rows) AS low_themes)
SELECT total_agents, total_calls, round(avg_s, 6) AS avg_sentiment, high_themes, medium_themes, low_themes,
  chr(10) || 'COACHING ANALYTICS CONTEXT:' || chr(10) || chr(10) || 'Dataset Overview:' || chr(10) ||
  '- Total Agents Analyzed: ' || cast(total_agents AS varchar) || chr(10) ||
  '- Total Calls: ' || format('{{:,}}', total_calls) || chr(10) ||
  '- Average Sentiment: ' || coalesce(printf('%.2f', avg_s), 'nan') || '/5.0' || chr(10) || chr(10) ||
  'Theme Distribution:' || chr(10) ||
  coalesce((SELECT string_agg('- #' || cast(rank AS varchar) || ' Theme: ' || theme || ' (' || cast(n AS varchar) ||
      ' agents, ' || printf('%.1f', n * 100.0 / total_agents) || '%)' || chr(10), '' ORDER BY rank) FROM top3), '') ||
  chr(10) || 'Priority Breakdown:' || chr(10) ||
  '- High Priority: ' || cast(high_themes AS varchar) || ' themes requiring immediate attention' || chr(10) ||
  '- Medium Priority: ' || cast(medium_themes AS varchar) || ' themes' || chr(10) ||
  '- Low Priority: ' || cast(low_themes AS varchar) || ' themes' || chr(10) ||
  {O.quote_sql(RP.CONTEXT_TEMPLATE.split("{low} themes" + chr(10))[1])} AS context_text
FROM nums""",
)(lambda spark, sf: RP.analytics_context(counted_turns(spark, sf), theme_rows(spark, sf)))

_SUMMARY = {
    "agents": "cast(total_agents AS varchar)", "calls": "format('{:,}', total_calls)", "date": "'February 07, 2025'",
    "sentiment": "coalesce(printf('%.2f', avg_sentiment), 'nan')", "high": "cast(high_themes AS varchar)",
    "needs": "CASE WHEN focus_theme <> '' THEN '- Top coaching needs: ' || top_themes_text || chr(10) ELSE '' END",
    "pillar": "top_pillar", "demand": "cast(top_pillar_n AS varchar)", "performers": "cast(high_performers AS varchar)",
    "moderate": "cast(moderate AS varchar)", "priority": "cast(priority_coaching AS varchar)",
    "workshop": "CASE WHEN focus_theme <> '' THEN '- Conduct focused workshop on ' || focus_theme || ' (most common challenge)' || chr(10) ELSE '' END",
}
register("exec_summary_text", f"{EXEC_CTES} SELECT {O.text_template(RP.SUMMARY_TEMPLATE, _SUMMARY)} AS summary_text FROM ({EXEC_SQL})")(
    lambda spark, sf: RP.exec_summary_text(counted_turns(spark, sf), theme_rows(spark, sf), run_date="February 07, 2025")
)

register(
    "agent_profile",
    _theme_sql(FIRST_PILLAR_SQL, SCORES_SQL)
    + f""", firsts AS (SELECT DISTINCT agent FROM theme_rows)
SELECT f.agent,
  coalesce((SELECT string_agg(pillar || ': ' || cast(score AS varchar) || ' coaching points', chr(10) ORDER BY pillar_ord)
            FROM ps WHERE ps.agent = f.agent AND score > 0), '') AS framework_text,
  (SELECT string_agg(cast(theme_pos + 1 AS varchar) || '. ' || theme || chr(10) || 'Priority Level: ' || upper(priority) ||
      CASE WHEN length(recommendation) > 0 THEN chr(10) || recommendation || '...' ELSE '' END,
      chr(10) ORDER BY theme_pos) FROM theme_rows r WHERE r.agent = f.agent AND theme_pos < 3) AS themes_text
FROM firsts f""",
)(lambda spark, sf: RP.agent_profile(theme_rows(spark, sf)))


PLAN_DATE = "February 07, 2025"
_EQ, _DASH = "repeat('=', 60)", "repeat('-', 60)"
PLAN_SQL = BOTH_RUN + f""",
  blocks AS (
    SELECT agent, theme_pos,
      chr(10) || cast(row_number() OVER (PARTITION BY agent ORDER BY theme_pos) AS varchar) || '. ' || upper(theme) || chr(10) ||
      '   Priority: ' || CASE priority WHEN 'high' THEN '[HIGH PRIORITY]' WHEN 'medium' THEN '[MEDIUM PRIORITY]'
        WHEN 'low' THEN '[LOW PRIORITY]' ELSE '[LOW]' END || chr(10) ||
      '   ' || chr(10) || '   Recommendation:' || chr(10) || '   ' || recommendation || chr(10) ||
      CASE WHEN len(examples) > 0 THEN '   ' || chr(10) || '   Examples:' || chr(10) || '   • ' || examples[1] || chr(10) ||
        CASE WHEN len(examples) > 1 THEN '   • ' || examples[2] || chr(10) ELSE '' END ELSE '' END ||
      chr(10) || {_DASH} || chr(10) AS block
    FROM theme_rows),
  plans AS (
    SELECT agent,
      'COACHING PLAN FOR ' || upper(agent) || chr(10) || {_EQ} || chr(10) || chr(10) || 'SUMMARY' || chr(10) ||
      '   • Calls Analyzed: ' || cast(max(calls) AS varchar) || chr(10) || '   • Date Generated: {PLAN_DATE}' || chr(10) || chr(10) ||
      {_EQ} || chr(10) || chr(10) || 'COACHING THEMES' || chr(10) ||
      string_agg(block, '' ORDER BY theme_pos) ||
      chr(10) || 'STRENGTHS' || chr(10) || '   • Strength ' || cast({O.AGENT_NO} % 3 AS varchar) || chr(10) ||
      chr(10) || {_EQ} || chr(10) ||
      chr(10) || {O.quote_sql(RP.DEFAULT_FOOTER)} || chr(10) AS plan_text
    FROM blocks JOIN ra USING (agent) GROUP BY agent)
"""


def _plans(spark: SparkSession, sf: str):
    tr = theme_rows(spark, sf)
    ins = X.insights_from_theme_rows(tr)
    return RP.coaching_plan_text(tr, ins.select("agent", "strengths"), run_agents(spark, sf), run_date=PLAN_DATE)


register("coaching_plan_text", PLAN_SQL + "SELECT agent, plan_text FROM plans")(_plans)

_URL = "replace(url_encode({x}), '%2F', '/')"  # the standard quoting rules keep '/'
register(
    "mailto_link",
    PLAN_SQL
    + "SELECT agent, 'mailto:?subject=' || "
    + _URL.format(x="'Coaching Plan - ' || agent")
    + " || '&body=' || "
    + _URL.format(x="plan_text")
    + " AS mailto FROM plans",
)(lambda spark, sf: RP.mailto_link(_plans(spark, sf)))

_PLAIN = "to_json({'coaching_themes': coaching_themes, 'strengths': strengths})::varchar"
register(
    "response_content",
    INS_CTES
    + f"""SELECT agent,
      CASE {CLASS_SQL} WHEN 2 THEN 'error' WHEN 3 THEN 'no_choices' WHEN 7 THEN 'no_response' END AS status,
      CASE {CLASS_SQL} WHEN 0 THEN {_PLAIN} WHEN 1 THEN {_PLAIN}
        WHEN 4 THEN substr({_PLAIN}, 1, length({_PLAIN}) - 1) WHEN 5 THEN '[]'
        WHEN 6 THEN to_json({{'coaching_themes': odd_themes, 'strengths': strengths}})::varchar END AS content
    FROM ins""",
)(lambda spark, sf: V.response_content(_responses(spark, sf)))

register(
    "cache_count",
    THC + "SELECT cast(count(*) AS bigint) AS n_rows, count(*) > 0 AS has_coaching FROM theme_rows",
)(lambda spark, sf: RP.cache_count(E.coaching_cache(theme_rows(spark, sf), RUN_STAMP, MODEL)))

# -- single-operator keys ------------------------------------------------------------
# SURVEY §2 lines that otherwise only run inside larger queries get their own key.

from callsight.functions.text import truncate_text  # noqa: E402

register("read_parquet", "SELECT conv_id, turn, role, text FROM conversations")(
    lambda spark, sf: Y.read_parquet(spark, f"{sf.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
)

register("total_calls", TC + "SELECT cast(count(DISTINCT call_id) AS bigint) AS total_calls FROM turns")(
    lambda spark, sf: A.total_calls(counted_turns(spark, sf))
)
register("total_agents", TC + "SELECT cast(count(DISTINCT agent) AS bigint) AS total_agents FROM turns")(
    lambda spark, sf: A.total_agents(counted_turns(spark, sf))
)
register(
    "distinct_rows", TC + "SELECT DISTINCT call_id, agent, sentiment_score FROM turns WHERE sentiment_score IS NOT NULL"
)(lambda spark, sf: A.distinct_call_sentiments(counted_turns(spark, sf)))

register(
    "turn_filter",
    TC + "SELECT call_id, agent, turn_idx, timestamp, speaker, message, sentiment_score FROM turns WHERE speaker = 'agent'",
)(lambda spark, sf: S.speaker_turns(turns(spark, sf), "agent"))

register(
    "truncate_text",
    TC + """SELECT call_id, turn_idx,
      CASE WHEN length(message) > 100 THEN substr(message, 1, 100) || '...' ELSE message END AS short FROM turns""",
)(lambda spark, sf: turns(spark, sf).select("call_id", "turn_idx", truncate_text("message").alias("short")))

register(
    "normalize_speaker",
    O.with_ctes(O.TURNS_SRC)
    + "SELECT DISTINCT CASE WHEN conv_id % 2 = 0 THEN upper(speaker_label) ELSE speaker_label END AS label, speaker FROM turns_src",
)(lambda spark, sf: P.speaker_labels(calls(spark, sf)))


@register(
    "filter_to_agents",
    TC + f"""SELECT call_id, agent, turn_idx, timestamp, speaker, message, sentiment_score FROM turns
    WHERE agent IN (SELECT agent FROM ({AGENT_CALLS_SQL}) WHERE n_calls >= {MIN_CALLS})""",
)
def _filter_to_agents(spark: SparkSession, sf: str):
    t = stored_turns(spark, sf)
    return S.filter_to_agents(t, S.eligible_agents(t, MIN_CALLS))


@register(
    "filter_to_agents_salted",
    TC + f"""SELECT call_id, agent, turn_idx, timestamp, speaker, message, sentiment_score FROM turns
    WHERE agent IN (SELECT agent FROM ({AGENT_CALLS_SQL}) WHERE n_calls >= {MIN_CALLS})""",
)
def _filter_salted(spark: SparkSession, sf: str):
    t = stored_turns(spark, sf)
    return S.filter_to_agents(t, S.eligible_agents(t, MIN_CALLS), salts=16)


@register(
    "attach_responses",
    THC + f"""SELECT agent, cast(floor((row_number() OVER (ORDER BY agent) - 1) / 20) + 1 AS bigint) AS batch_no,
      cast({CLASS_SQL} AS int) AS response_class FROM (SELECT DISTINCT agent FROM theme_rows)
    QUALIFY {CLASS_SQL} IN (0, 1, 6)""",
)
def _attach(spark: SparkSession, sf: str):
    requests = S.agent_batches(theme_rows(spark, sf), 20).select("agent", "batch_no")
    out = V.attach_responses(requests, _responses(spark, sf))
    return out.select("agent", "batch_no", (X.agent_number() % X.RESPONSE_CLASSES).cast("int").alias("response_class"))


register(
    "pillar_match",
    THC + """SELECT r.agent, r.theme_pos, r.theme,
      (SELECT l.pillar FROM theme_lexicon l WHERE contains(r.theme, l.theme) ORDER BY l.pillar_ord LIMIT 1) AS first_pillar,
      cast((SELECT count(DISTINCT l.pillar_ord) FROM theme_lexicon l WHERE contains(lower(r.theme), lower(l.theme))) AS int)
        AS n_pillars_ci
    FROM theme_rows r""",
)(lambda spark, sf: H.pillar_matches(theme_rows(spark, sf)))

register(
    "validate_insights",
    THC + f"""SELECT agent,
      to_json(list({{'theme': theme, 'priority': CASE WHEN {CLASS_SQL} = 6 THEN 'low' ELSE priority END,
            'frequency': CASE WHEN {CLASS_SQL} = 6 THEN cast(0 AS bigint) ELSE frequency END,
            'examples': examples, 'recommendation': recommendation}} ORDER BY theme_pos))::varchar AS coaching_themes,
      ['Strength ' || cast({O.AGENT_NO} % 3 AS varchar)] AS strengths
    FROM theme_rows WHERE {CLASS_SQL} IN (0, 1, 6) GROUP BY agent""",
)(
    # Nested result compared as JSON text: the theme list in order, every field after coercion.
    lambda spark, sf: V.validate_insights(_responses(spark, sf)).select(
        "agent", F.to_json("coaching_themes").alias("coaching_themes"), "strengths"
    )
)

# The turn cleaning (markup, then whitespace) over raw web pages: every page, whole.
_PY_WS_CLASS = r"[\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PY_WS = _PY_WS_CLASS + "+"
register(
    "clean_pages",
    "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, "
    + f"'(?i)<br{_PY_WS_CLASS}*/?>', ' ', 'g'), '<[^>]+>', '', 'g'), "
    + f"'{_PY_WS}', ' ', 'g')) AS html FROM pages",
)(lambda spark, sf: P.clean_markup_text(X.read_table(spark, sf, "pages"), "page_id", "html"))
