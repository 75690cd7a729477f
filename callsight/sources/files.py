"""Reading call files (CSV, Parquet, text), aligning them, and mapping user columns.

Readers are plain ``spark.read`` calls with explicit schemas where the
layout is known. Each reader returns a DataFrame; the union aligns columns
by name and fills missing ones with null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.functions.scalars import one_value
from callsight.functions.text import pad_left, strip_ws
from callsight.operators.ordinal import with_global_ordinal

CALLS_SCHEMA = "call_id STRING, agent STRING, transcript STRING, sentiment_score DOUBLE"

# Fixed values that must equal the reference: accepted extensions and the
# constant agent name of a text upload.
SUPPORTED_EXTENSIONS = ("csv", "parquet", "txt")
TEXT_AGENT = "Unknown"
TEXT_CALL_PREFIX = "CALL_"


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, infer_schema: bool = False, multi_line: bool = True
) -> DataFrame:
    """Header CSV; quoted fields may span lines (RFC-4180 doubled quotes).

    Without a schema every column is read as text: ``map_columns`` casts the
    mapped columns anyway, and inference would be a full extra pass over
    the data (``infer_schema=True`` opts in). ``multiLine`` makes each file
    one split, so parallelism then comes from the number of files. For large
    files, ``csvlines.read_csv_lines`` gives the same rows from many tasks;
    ``multi_line=False`` splits uploads known to hold one record per line.
    """
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema:
        return r.schema(schema).csv(path)
    if infer_schema:
        return r.option("inferSchema", True).csv(path)
    return r.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text_calls(spark: SparkSession, path: str) -> DataFrame:
    """Each text file is one call: ``CALL_0001``… by file path order, agent 'Unknown'.

    Unlike the reference (one fixed id for every text file) each file gets
    its own id, so two files never merge into one call. Only the path column
    is numbered (the distributed ordinal checkpoints paths, never texts);
    the numbers are joined back to the file contents on the path.
    """
    files = spark.read.format("binaryFile").load(path)
    numbered = with_global_ordinal(files.select("path"), [F.col("path")], "file_no")
    texts = files.select("path", F.decode(F.col("content"), "UTF-8").alias("transcript"))
    return texts.join(numbered, "path").select(
        F.concat(F.lit(TEXT_CALL_PREFIX), pad_left(F.col("file_no"), 4)).alias("call_id"),
        F.lit(TEXT_AGENT).alias("agent"),
        "transcript",
    )


def read_calls(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Dispatch on the extension; unsupported extensions give None (skipped)."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext == "csv":
        return read_csv(spark, path, schema)
    if ext == "parquet":
        return read_parquet(spark, path)
    if ext == "txt":
        return read_text_calls(spark, path)
    return None


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _widened_types(frames: list[DataFrame]) -> dict[str, str]:
    """Columns typed differently across inputs → the type all inputs are cast to.

    All numeric → DOUBLE; otherwise STRING (a text column holds every value,
    as a mixed column does after concatenating frames). Without this, the
    union's implicit coercion may cast text to a number and fail at run time.
    """
    seen: dict[str, set[str]] = {}
    for f in frames:
        for name, dtype in f.dtypes:
            seen.setdefault(name, set()).add(dtype)
    out = {}
    for name, types in seen.items():
        if len(types) > 1:
            out[name] = "double" if all(t in _NUMERIC or t.startswith("decimal") for t in types) else "string"
    return out


def union_files(frames: list[DataFrame | None]) -> DataFrame:
    """Union by column name; columns missing in a frame become null; skipped inputs ignored.

    Columns whose types differ between inputs are widened explicitly first.
    """
    kept = [f for f in frames if f is not None]
    wide = _widened_types(kept)
    if wide:
        kept = [f.select(*[F.col(c).cast(wide[c]).alias(c) if c in wide else F.col(c) for c in f.columns]) for f in kept]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def map_columns(
    raw: DataFrame,
    call_id: str,
    agent: str,
    transcript: str,
    sentiment: str | None = None,
    passthrough: tuple[str, ...] = (),
) -> DataFrame:
    """User columns → ``calls(call_id, agent, transcript, sentiment_score)``.

    The three required columns must exist (checked when the plan is built).
    A missing sentiment mapping gives a null column. NaN or non-numeric
    sentiment becomes null here, once, so later averages skip it.
    """
    missing = [c for c in (call_id, agent, transcript) if c not in raw.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}")
    s: Column
    if sentiment and sentiment != "None":
        v = F.col(sentiment).try_cast("double")  # a malformed value is a missing score, not a failed job
        s = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    else:
        s = F.lit(None).cast("double")
    return raw.select(
        F.col(call_id).cast("string").alias("call_id"),
        F.col(agent).cast("string").alias("agent"),
        F.col(transcript).cast("string").alias("transcript"),
        s.alias("sentiment_score"),
        *[F.col(c) for c in passthrough],
    )


def write_parquet(df: DataFrame, path: str) -> None:
    """Snappy Parquet, overwrite."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_text_calls(calls: DataFrame, path: str) -> None:
    """One text file per call (test helper): a folder per ``call_id`` holding its transcript."""
    calls.select("call_id", "transcript").repartition("call_id").write.mode("overwrite").partitionBy("call_id").text(path)


def active_themes(spark: SparkSession, mode: str, lexicon: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Theme list in use: 'preloaded', 'custom' or 'both' (append, no dedupe), ordered by ``theme_ord``.

    ``custom`` holds lines of user text in a ``line`` column with a ``line_no``;
    lines are stripped and blanks dropped.
    """
    pre = lexicon.select(F.col("theme_ord").cast("bigint").alias("theme_ord"), "theme")
    if custom is None or mode == "preloaded":
        return pre
    cleaned = custom.select(
        "line_no", strip_ws("line").alias("theme")
    ).where(F.col("theme") != "")
    offset = F.lit(0) if mode == "custom" else one_value(lexicon.agg(F.count(F.lit(1))))  # 30 fixed rows
    numbered = with_global_ordinal(cleaned, [F.col("line_no")], "_o")
    cust = numbered.select((F.col("_o") - 1 + offset).cast("bigint").alias("theme_ord"), "theme")
    return cust if mode == "custom" else pre.unionByName(cust)
