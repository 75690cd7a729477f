"""Transcript parsing: one call row in, zero or more speaker-turn rows out.

Everything is a native expression evaluated per call row (split, regex
extraction, higher-order array functions) followed by one ``posexplode``.
There is no shuffle: the output keeps the input partitioning, so parsing
scales with the number of input files/partitions. A transcript is one value
by definition, so each is processed whole; nothing is grouped.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.functions import text as T

TURN_COLUMNS = ["call_id", "agent", "turn_idx", "timestamp", "speaker", "message", "sentiment_score"]


def _pipe_turns(t: Column) -> Column:
    """Pipe form: split on '|', strip, skip blanks, keep segments whose start matches the turn header.

    The turn pattern is ``header \\s* (.*)`` with ``.`` stopping at a newline,
    so once the short header matched, the message is the first line of the
    rest after its leading whitespace; the header is matched once per segment.
    """
    head = T.PIPE_HEADER_PATTERN_J
    segments = F.filter(F.transform(F.split(t, r"\|", -1), lambda s: T.strip_ws(s)), lambda s: s != "")
    heads = F.filter(
        F.transform(segments, lambda s: F.struct(F.regexp_extract(s, head, 0).alias("h"), s.alias("s"))),
        lambda x: x["h"] != "",
    )
    return F.transform(
        heads,
        lambda x: F.struct(
            F.regexp_extract(x["h"], head, 1).alias("ts"),
            F.regexp_extract(x["h"], head, 2).alias("spk"),
            F.substring_index(T.lstrip_ws(F.substring(x["s"], F.length(x["h"]) + 1, 1 << 30)), "\n", 1).alias("msg"),
        ),
    )


def _bracket_turns(t: Column) -> Column:
    """Bracket form: every header up to the next header or the end (DOTALL).

    Finding all headers and splitting on the same header pattern both scan
    left to right for non-overlapping headers, so they see the same header
    sequence as the full turn pattern would; the split pieces after the
    first are exactly the bodies (text up to the next header or the end).
    This scans for headers only, instead of testing a lookahead at every
    character of every body. Leading/trailing whitespace of a body is removed
    later by the whitespace collapse, as the pattern's ``\\s*`` and ``$`` would.
    """
    headers = F.regexp_extract_all(t, F.lit(T.BRACKET_HEADER_FIND_J), 0)
    bodies = F.slice(F.split(t, T.BRACKET_HEADER_FIND_J, -1), 2, F.size(headers))
    return F.transform(
        F.arrays_zip(headers.alias("h"), bodies.alias("b")),
        lambda x: F.struct(
            F.regexp_extract(x["h"], T.BRACKET_HEADER_PATTERN_J, 1).alias("ts"),
            F.regexp_extract(x["h"], T.BRACKET_HEADER_PATTERN_J, 2).alias("spk"),
            x["b"].alias("msg"),
        ),
    )


def raw_turns(t: Column) -> Column:
    """ARRAY<STRUCT<ts, spk, msg>> of unparsed turns; the format is chosen per row."""
    fmt = T.detect_format(t)
    return F.when(fmt == "pipe", _pipe_turns(t)).when(fmt == "bracket", _bracket_turns(t))


def clean_turns(t: Column, redact: bool = True) -> Column:
    """Parsed turns with cleaned, redacted messages and normalized speakers; empty messages dropped.

    Two array stages: the first computes each derived value once (stripped
    lower-case label, cleaned message); the second reads them as lambda
    variables, so nothing is recomputed per reference. Timestamps need no
    strip: both formats capture them from a digit to a digit.
    """
    stage1 = F.transform(
        raw_turns(t),
        lambda x: F.struct(
            x["ts"].alias("timestamp"),
            F.lower(T.strip_ws(x["spk"])).alias("low"),
            T.clean_message(x["msg"]).alias("message"),
        ),
    )
    kept = F.filter(stage1, lambda x: F.length(x["message"]) > 0)
    return F.transform(
        kept,
        lambda x: F.struct(
            x["timestamp"].alias("timestamp"),
            T.speaker_from_lower(x["low"]).alias("speaker"),
            (T.redact_pii(x["message"]) if redact else x["message"]).alias("message"),
        ),
    )


def _side(turns: Column, speaker: str, n: int) -> Column:
    """The first ``n`` turns of one side, redacted: ARRAY<STRUCT<turn_idx, message>>."""
    own = F.slice(F.filter(turns, lambda x: x["speaker"] == speaker), 1, n)
    return F.transform(own, lambda x: F.struct(x["turn_idx"].alias("turn_idx"), T.redact_pii(x["message"]).alias("message")))


def call_heads(calls: DataFrame, n: int = 3) -> DataFrame:
    """``calls`` → per row its number of turns and the first ``n`` messages of either side; calls without turns are left out.

    Everything a digest needs, taken from the call's turn array in the parsing
    pass itself: no turn rows, no window, no shuffle, and only the messages that
    are kept are redacted. The result is a small part of the transcripts.
    """
    parsed = calls.withColumn("_turns", _clean_turns_of("transcript", False)).filter("size(_turns) > 0")
    # A generator's output is computed once a row; a plain column would be parsed again for each use.
    numbered = F.transform("_turns", lambda x, i: F.struct(i.cast("int").alias("turn_idx"), x["speaker"].alias("speaker"), x["message"].alias("message")))
    once = parsed.select("call_id", "agent", "sentiment_score", F.explode(F.array(numbered)).alias("turns"))
    turns = F.col("turns")
    return once.select(
        "call_id",
        "agent",
        "sentiment_score",
        F.size(turns).cast("bigint").alias("n_turns"),
        _side(turns, "customer", n).alias("customer"),
        _side(turns, "agent", n).alias("agent_side"),
    )


@lru_cache(maxsize=16)
def _clean_turns_of(column: str, redact: bool) -> Column:
    """``clean_turns`` of a named column, built once per process.

    The expression is a constant tree of a few thousand nodes; building it
    is driver work that does not depend on the data, like compiling a
    regex once. Column expressions are unresolved, so one instance serves
    every plan (and session) that has a column of that name.
    """
    return clean_turns(F.col(column), redact=redact)


def parse_turns(calls: DataFrame, keep_original: bool = False, redact: bool = True) -> DataFrame:
    """``calls(call_id, agent, transcript, sentiment_score)`` → turn table.

    ``turn_idx`` is the 0-based position of the turn inside its call. With
    ``keep_original`` the raw transcript is carried on every turn, as the
    reference does; it multiplies the text by the turn count, so it is off
    by default (join back on ``call_id`` when needed).
    """
    extra = [F.col("transcript").alias("original_transcript")] if keep_original else []
    exploded = calls.select(
        "call_id",
        "agent",
        "sentiment_score",
        *extra,
        F.posexplode(_clean_turns_of("transcript", redact)).alias("turn_idx", "t"),
    )
    return exploded.select(
        "call_id",
        "agent",
        F.col("turn_idx").cast("int").alias("turn_idx"),
        F.col("t.timestamp").alias("timestamp"),
        F.col("t.speaker").alias("speaker"),
        F.col("t.message").alias("message"),
        "sentiment_score",
        *(["original_transcript"] if keep_original else []),
    )


def speaker_labels(calls: DataFrame) -> DataFrame:
    """Distinct raw speaker labels of the parsed turns and their normalized speaker."""
    raw = calls.select(F.explode(raw_turns(F.col("transcript"))).alias("t"))
    return raw.select(T.strip_ws(F.col("t.spk")).alias("label")).distinct().select("label", T.normalize_speaker("label").alias("speaker"))


def clean_markup_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text)`` with markup removed and whitespace collapsed: the turn cleaning, for any text column."""
    return df.select(key, T.clean_message(text).alias(text))


def call_formats(calls: DataFrame) -> DataFrame:
    """Per call: detected format (pipe/bracket/null)."""
    return calls.select("call_id", "agent", T.detect_format("transcript").alias("format"))


def parse_summary(calls: DataFrame) -> DataFrame:
    """Per call: format and the number of turns parsed; calls with zero turns are visible here."""
    return calls.select(
        "call_id",
        "agent",
        T.detect_format("transcript").alias("format"),
        F.coalesce(F.size(_clean_turns_of("transcript", False)), F.lit(0)).cast("bigint").alias("n_turns"),
    ).withColumn("n_turns", F.greatest(F.col("n_turns"), F.lit(0)).cast("bigint"))


def register_turns(turns: DataFrame, path: str) -> DataFrame:
    """Write the turn table once (snappy Parquet in a shared folder) and read it back.

    Downstream steps (eligibility, worst calls, digests) each scan the turn
    table; reading the written table avoids re-running the regex parse per
    branch and cuts the lineage, so a lost executor re-reads files instead
    of re-parsing transcripts.
    """
    turns.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return turns.sparkSession.read.parquet(path)
