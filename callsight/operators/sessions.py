"""Saved analysis sessions as a stored table of versions, a key per dataset fingerprint and session.

A session is the insights of one run (one row per agent) stamped with the
dataset fingerprint (``file_hash``), the session time, the model and the
filter criteria. Each session is one key of a versioned store (``versions``):
its rows are written to a folder of their own and become visible by one log row,
so a save that fails leaves what was there, and saving the same session again
(a re-run after a failure) replaces it instead of adding a copy. Listings are
read off the log alone, a session's rows from its own folder. The store lives in
a shared folder (a path the caller gives, e.g. under the cluster's checkpoint dir).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.functions.scalars import one_value
from callsight.operators import versions

FINGERPRINT_CHARS = 12
#: Columns of a stored session before those of the insights. Keys carry a letter: one made of digits would be read as a number.
STAMP = "file_hash string, session_ts timestamp, model_used string, filter_criteria map<string,string>"
INSIGHTS = (
    "agent string, coaching_themes array<struct<theme:string,priority:string,frequency:bigint,examples:array<string>,recommendation:string>>, "
    "strengths array<string>"
)


def _csv_field(c) -> F.Column:
    """A value as a CSV field: null → '', quoted when it holds a comma, quote or newline."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    needs = s.contains(",") | s.contains('"') | s.contains("\n") | s.contains("\r")
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def dataset_fingerprint(turns: DataFrame, first_rows: int | None = None, order: tuple[str, ...] = ("call_id", "turn_idx")) -> DataFrame:
    """One row: 12 hex characters that depend on every row and on no order of them.

    Each row's CSV text is hashed on its own; the number of rows, the sum and
    the exclusive or of their hashes are hashed together, so partial sums meet
    in one row. ``first_rows`` looks at the first rows in ``order`` alone
    (faster, but two datasets with an equal beginning get one fingerprint).
    """
    cols = turns.columns
    if first_rows is not None:  # ties on every other column: the rows are the same on every run
        turns = turns.orderBy(*order, *[c for c in cols if c not in order]).limit(first_rows)
    one = hashed_rows(turns).agg(*hash_sums()).select(F.lit(",".join(cols)).alias("columns"), "n", "s", "x")
    return fingerprint_of(one)


def hashed_rows(turns: DataFrame, *carry: str) -> DataFrame:
    """``h``: the hash of each row's CSV text, 60 bits; ``carry`` names columns that come along."""
    line = F.md5(F.concat_ws(",", *[_csv_field(F.col(c)) for c in turns.columns]))
    return turns.select(F.conv(F.substring(line, 1, 15), 16, 10).cast("bigint").alias("h"), *carry)


def hash_sums() -> list[Column]:
    """Number, sum and exclusive or of the row hashes: those of two datasets add up to those of both."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("s"),
        F.coalesce(F.expr("bit_xor(h)"), F.lit(0)).alias("x"),
    ]


def fingerprint_of(state: DataFrame) -> DataFrame:
    """The fingerprint of a one-row state (columns, n, s, x)."""
    text = F.concat_ws(",", "columns", F.col("n").cast("string"), F.col("s").cast("decimal(38,0)").cast("string"), F.col("x").cast("string"))
    return state.select(F.substring(F.md5(text), 1, FINGERPRINT_CHARS).alias("file_hash"))


def _value(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _key(spark: SparkSession, file_hash: str | Column, session_ts: str) -> tuple[str, str]:
    """(key, fingerprint) as texts; a fingerprint that is computed on the cluster is computed here, once."""
    when = F.date_format(F.to_timestamp(F.lit(session_ts)), "yyyyMMddHHmmssSSS")
    one = spark.range(1).select(_value(file_hash).alias("f"), when.alias("t")).first()  # two short texts
    return f"h{one['f']}-s{one['t']}", one["f"]


def save_session(
    insights: DataFrame,
    path: str,
    file_hash: str | Column,
    session_ts: str,
    model_used: str,
    filter_criteria: dict[str, str] | None = None,
) -> None:
    """Adds one session (all its agents) to the store, or replaces it; a save that fails changes nothing.

    ``file_hash`` is a literal or a one-value column such as
    ``one_value(dataset_fingerprint(turns))`` (computed on the cluster).
    """
    key, fingerprint = _key(insights.sparkSession, file_hash, session_ts)
    crit = [x for k, v in sorted((filter_criteria or {}).items()) for x in (F.lit(k), F.lit(str(v)))]
    ts = F.to_timestamp(F.lit(session_ts))
    out = insights.select(
        F.lit(fingerprint).alias("file_hash"),
        ts.alias("session_ts"),
        F.lit(model_used).alias("model_used"),
        (F.create_map(*crit) if crit else F.create_map().cast("map<string,string>")).alias("filter_criteria"),
        *insights.columns,
    )
    versions.put(out, path, key, {"file_hash": F.lit(fingerprint), "session_ts": ts, "model_used": F.lit(model_used)})


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(key, file_hash, session_ts, model_used, n_agents) of every stored session, off the log."""
    v = F.from_json("values", "file_hash string, session_ts timestamp, model_used string, n_rows bigint").alias("v")
    return versions.live(spark, path).select("key", v).select("key", "v.file_hash", "v.session_ts", "v.model_used", F.col("v.n_rows").alias("n_agents"))


def read_sessions(spark: SparkSession, path: str, insights: str = INSIGHTS) -> DataFrame:
    """The rows of all stored sessions; ``insights`` names their own columns where they are others than an insight's."""
    return versions.stored(spark, path, f"{STAMP}, {insights}").drop("key", "version")


def latest_session(spark: SparkSession, path: str, file_hash: str | Column, insights: str = INSIGHTS) -> DataFrame:
    """Rows of the newest session of ``file_hash`` (folder-pruned, also for a subquery value); empty if none."""
    mine = _listed(spark, path).where(F.col("file_hash") == _value(file_hash))
    newest = one_value(mine.agg(F.max_by("key", "session_ts").alias("key")))
    return versions.stored(spark, path, f"{STAMP}, {insights}", newest).drop("key", "version")


def list_sessions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Sessions newest first with their agent counts (all, or the newest ``limit``); no data file is opened."""
    s = _listed(spark, path).drop("key").orderBy(F.desc("session_ts"), F.asc("file_hash"))
    return s.limit(limit) if limit else s


def delete_session(spark: SparkSession, path: str, file_hash: str | Column, session_ts: str, insights: str = INSIGHTS) -> DataFrame:
    """The store without one session: a log row, no other file is read or written (``versions.remove_unused`` frees the space)."""
    versions.take_away(spark, path, _key(spark, file_hash, session_ts)[0])
    return read_sessions(spark, path, insights)


def previous_agents(session: DataFrame) -> DataFrame:
    """Agents already analysed in a session."""
    return session.select("agent").distinct()


def session_metadata(turns: DataFrame, insights: DataFrame, processed_at: str, model_used: str) -> DataFrame:
    """One row: processed_at, model_used, distinct calls, agents in the insights."""
    c = turns.agg(F.countDistinct("call_id").cast("bigint").alias("total_calls"))
    a = one_value(insights.agg(F.countDistinct("agent").cast("bigint").alias("total_agents")))
    return c.select(
        F.lit(processed_at).alias("processed_at"), F.lit(model_used).alias("model_used"), "total_calls", a.alias("total_agents")
    )


def insights_json(insights: DataFrame) -> DataFrame:
    """Per agent: the insights object as JSON text."""
    payload = [c for c in insights.columns if c != "agent"]
    return insights.select("agent", F.to_json(F.struct(*payload)).alias("insights_json"))
