"""Model responses → validated insights, entirely with VARIANT expressions.

Input ``responses(agent, response)`` holds the raw HTTP body of each
request (or null). Every step is per row: parse the envelope, take
``choices[0].message.content``, strip code fences, parse the content, then
coerce each theme the way the reference's validator does. Type tests use
``schema_of_variant``; values are cast last. One response is bounded by the
request's ``max_tokens``, so exploding its theme list is bounded per row.

Parsing relies on ``spark.sql.variant.allowDuplicateKeys=true`` (last key
wins, as in Python); the session builder sets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.functions.text import strip_ws

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's validator.
# ---------------------------------------------------------------------------
UNKNOWN_THEME = "Unknown Theme"
INVALID_THEME_RECOMMENDATION = "Invalid theme data"
VALID_PRIORITIES = ("high", "medium", "low")
DEFAULT_PRIORITY = "low"
FENCE_JSON_PATTERN = r"```json\n?"
FENCE_PATTERN = r"```\n?"
# ---------------------------------------------------------------------------

_NUMERIC_PREFIXES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")

THEME_TYPE = (
    "ARRAY<STRUCT<theme: STRING, priority: STRING, frequency: BIGINT, examples: ARRAY<STRING>, recommendation: STRING>>"
)


def _kind(v: Column) -> Column:
    """Upper-case type name of a variant value ('OBJECT<…>', 'STRING', 'VOID', …); SQL null stays null."""
    return F.schema_of_variant(v)


def _get(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, path, typ)


def _is_numeric(kind: Column) -> Column:
    cond = None
    for p in _NUMERIC_PREFIXES:
        c = kind.startswith(p)
        cond = c if cond is None else (cond | c)
    return cond


def _truthy(v: Column, kind: Column | None = None) -> Column:
    """Python truthiness of a JSON value; a missing value (SQL null) is falsy. ``kind`` is its type name where already known."""
    k = _kind(v) if kind is None else kind
    return (
        F.when(v.isNull() | (k == "VOID"), F.lit(False))
        .when(k == "BOOLEAN", _get(v, "$", "boolean"))
        .when(k == "STRING", F.length(_get(v, "$", "string")) > 0)
        .when(_is_numeric(k), _get(v, "$", "double") != 0)
        .when(k.startswith("ARRAY"), F.size(_get(v, "$", "array<variant>")) > 0)
        .when(k.startswith("OBJECT"), k != "OBJECT<>")
        .otherwise(F.lit(True))
    )


def _py_str(v: Column, kind: Column | None = None) -> Column:
    """``str(value)`` for JSON scalars: strings as is, booleans True/False, other values as JSON text."""
    k = _kind(v) if kind is None else kind
    return (
        F.when(k == "STRING", _get(v, "$", "string"))
        .when(k == "BOOLEAN", F.when(_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
        .when(k == "VOID", F.lit("None"))
        .otherwise(F.to_json(v))
    )


def _py_int(v: Column, kind: Column | None = None) -> Column:
    """``int(value)`` if the value is a JSON number or boolean (truncated toward zero), else 0.

    Python's integers have no limit; a number beyond 64 bits becomes the nearest 64-bit one.
    """
    k = _kind(v) if kind is None else kind
    number = _get(v, "$", "double")
    fits = number.try_cast("bigint")
    return (
        F.when(k == "BOOLEAN", _get(v, "$", "boolean").cast("bigint"))
        .when(k.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), _get(v, "$", "bigint"))
        .when(_is_numeric(k), F.coalesce(fits, F.when(number > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))))
        .otherwise(F.lit(0).cast("bigint"))
    )


def _str_list(v: Column) -> Column:
    """A JSON list as ARRAY<STRING> (elements via ``str``); anything else → []."""
    arr = _get(v, "$", "array<variant>")
    return F.when(_kind(v).startswith("ARRAY"), F.transform(arr, lambda x: _py_str(x))).otherwise(
        F.array().cast("array<string>")
    )


def python_json(text: Column) -> Column:
    """``text`` with Python's extra number words as JSON strings: NaN, Infinity and -Infinity outside of strings.

    As ``str`` would print them: no field of a theme treats such a number
    otherwise (a frequency that is none counts as 0). Only texts that hold one
    of the words are rewritten: strings and words are marked in one left-to-right pass, with characters that no JSON text may hold.
    """
    marked = F.regexp_replace(text, _STRINGS_AND_WORDS, "$1\x01$2\x02")
    out = F.replace(marked, F.lit("\x01\x02"), F.lit(""))
    for word, printed in (("NaN", "nan"), ("-Infinity", "-inf"), ("Infinity", "inf")):
        out = F.replace(out, F.lit(f"\x01{word}\x02"), F.lit(f'"{printed}"'))
    return F.when(text.rlike("NaN|Infinity") & ~text.rlike("[\x01\x02]"), out).otherwise(text)


_STRINGS_AND_WORDS = r'(?s)("(?:[^"\\]|\\.)*+")|(-?Infinity|NaN)'  # possessive: no recursion per character

_THEME_FIELDS = ("theme", "priority", "frequency", "examples", "recommendation")


def _theme_fields(x: Column) -> Column:
    """A theme value taken apart: each field, read once, and the value itself."""
    return F.struct(*(_get(x, f"$.{f}").alias(f) for f in _THEME_FIELDS), x.alias("whole"))


def _with_kinds(v: Column) -> Column:
    """The fields with their type names. A value with one of the fields is an object; only one that has none needs its own."""
    some = None
    for f in _THEME_FIELDS:
        some = v[f].isNotNull() if some is None else some | v[f].isNotNull()
    kinds = (_kind(v[f]).alias(f"{f}_kind") for f in ("theme", "priority", "frequency", "recommendation"))
    examples = _get(v["examples"], "$", "array<variant>").alias("items")  # null for anything but a list
    return F.struct((some | _kind(v["whole"]).startswith("OBJECT")).alias("is_object"), *(v[f].alias(f) for f in _THEME_FIELDS), *kinds, examples)


def validate_theme(x: Column) -> Column:
    """One theme value, as taken apart by ``_theme_fields`` → STRUCT(theme, priority, frequency, examples, recommendation)."""
    of = lambda f: (x[f], x[f"{f}_kind"])
    prio = F.when(x["priority_kind"] == "STRING", _get(x["priority"], "$", "string"))
    none = F.array().cast("array<string>")
    ok = F.struct(
        F.when(_truthy(*of("theme")), _py_str(*of("theme"))).otherwise(F.lit(UNKNOWN_THEME)).alias("theme"),
        F.when(prio.isin(*VALID_PRIORITIES), prio).otherwise(F.lit(DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce(_py_int(*of("frequency")), F.lit(0).cast("bigint")).alias("frequency"),
        F.coalesce(F.transform(x["items"], lambda e: _py_str(e)), none).alias("examples"),
        F.when(_truthy(*of("recommendation")), _py_str(*of("recommendation"))).otherwise(F.lit("")).alias("recommendation"),
    )
    bad = F.struct(
        F.lit(UNKNOWN_THEME).alias("theme"),
        F.lit(DEFAULT_PRIORITY).alias("priority"),
        F.lit(0).cast("bigint").alias("frequency"),
        none.alias("examples"),
        F.lit(INVALID_THEME_RECOMMENDATION).alias("recommendation"),
    )
    return F.when(x["is_object"], ok).otherwise(bad)


def strip_fences(c: Column) -> Column:
    """Remove ```json and ``` fences (each with an optional newline) anywhere, then strip."""
    return strip_ws(F.regexp_replace(F.regexp_replace(c, FENCE_JSON_PATTERN, ""), FENCE_PATTERN, ""))


def response_content(responses: DataFrame, carry: tuple[str, ...] = ("agent",)) -> DataFrame:
    """Per response: failure class (or null) and the stripped content string.

    Classes: no_response (null body, unreadable, or an empty value such as ``{}``), error (``error`` key), no_choices,
    exception (``choices[0].message.content`` is missing or not a string).
    """
    # Staged columns: the envelope is parsed once, each part taken once, the content's type read before any cast.
    rows = responses.select(*carry, F.try_parse_json(python_json(F.col("response"))).alias("_env"))
    parts = {"_inner": "$.choices[0].message.content", "_error": "$.error", "_choices": "$.choices"}
    rows = rows.select(*carry, "_env", *(_get(F.col("_env"), path).alias(name) for name, path in parts.items()))
    rows = rows.withColumn("_kind", _kind(F.col("_inner")))
    # An envelope with one of the keys is not empty; only one without needs its type name.
    status = (
        F.when(F.col("_error").isNotNull(), F.lit("error"))
        .when(F.col("_choices").isNotNull(), F.when(F.col("_inner").isNull() | (F.col("_kind") != "STRING"), F.lit("exception")))
        .when(_truthy(F.col("_env")), F.lit("no_choices"))
        .otherwise(F.lit("no_response"))
    )
    content = F.when(F.col("_kind") == "STRING", _get(F.col("_inner"), "$", "string"))
    return rows.select(*carry, status.alias("status"), strip_fences(content).alias("content"))


def single_value(content: Column) -> Column:
    """The JSON value that makes up all of ``content``, as Python's ``json.loads`` reads it; null for anything else.

    ``try_parse_json`` reads the first value and ignores what follows. So the
    text is read as the first element of a list whose second one is a hash of
    the text itself: text after the value, another value or a stray bracket
    either breaks the list or shifts the hash from its place, which no text
    can repair, as none holds its own hash.
    """
    mark = F.md5(content)
    listed = F.try_parse_json(F.concat(F.lit("["), python_json(content), F.lit(',"'), mark, F.lit('"]')))
    return F.transform(
        F.array(listed), lambda v: F.when((_get(v, "$[1]", "string") == mark) & _get(v, "$[2]").isNull(), _get(v, "$[0]"))
    )[0]


def parse_insights(responses: DataFrame, carry: tuple[str, ...] = ("agent",)) -> DataFrame:
    """Responses → (agent, status, insight VARIANT): insight is set only for a usable non-empty object.

    The content must be one JSON object and nothing else. ``carry`` names the columns that come along.
    """
    # Staged columns: the JSON is parsed once and its top level read once; status is then a column. The value comes out of
    # a generator, below which no later filter on it can be pushed (that would repeat the parse for each mention).
    parsed = response_content(responses, carry).select("*", F.explode(F.array(single_value(F.col("content")))).alias("_value"))
    fields = parsed.withColumn("_fields", F.size(_get(F.col("_value"), "$", "map<string,variant>")))
    value, size = F.col("_value"), F.col("_fields")
    status = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(value.isNull(), F.lit("bad_json"))
        .when(size > 0, F.lit("ok"))
        .when(size == 0, F.lit("empty"))
        .otherwise(F.when(_truthy(value), F.lit("not_object")).otherwise(F.lit("empty")))
    )
    with_status = fields.select(*carry, status.alias("status"), "_value")
    return with_status.select(*carry, "status", F.when(F.col("status") == "ok", value).alias("insight"))


def response_errors(responses: DataFrame) -> DataFrame:
    """Per agent: the outcome class (ok, no_response, error, no_choices, exception, bad_json, empty, not_object)."""
    return parse_insights(responses).select("agent", "status")


def _theme_list(v: Column) -> Column:
    """``coaching_themes`` as entries taken apart, falsy ones skipped; a non-list gives []."""
    arr = F.coalesce(_get(v, "$.coaching_themes", "array<variant>"), F.array().cast("array<variant>"))
    taken = F.transform(arr, _theme_fields)
    some = lambda x: x["theme"].isNotNull() | x["recommendation"].isNotNull()  # noqa: E731  an object that is not empty
    return F.transform(F.filter(taken, lambda x: some(x) | _truthy(x["whole"])), _with_kinds)


def validate_insights(responses: DataFrame) -> DataFrame:
    """Usable responses → ``insights(agent, coaching_themes, strengths)`` with the validator's coercions.

    Themes: a non-list becomes []; falsy entries are skipped; each entry is
    coerced like the reference's validator. Strengths: a non-list becomes [].
    Only these two keys are kept. One pass per row: no shuffle and no join, so
    two responses of one agent stay two rows with their own themes, and a null
    agent keeps its.
    """
    p = parse_insights(responses).where(F.col("status") == "ok")
    insight = F.col("insight")
    return p.select(
        "agent",
        F.transform(_theme_list(insight), validate_theme).cast(THEME_TYPE).alias("coaching_themes"),
        F.coalesce(_str_list(_get(insight, "$.strengths")), F.array().cast("array<string>")).alias("strengths"),
    )


def validated_theme_rows(responses: DataFrame) -> DataFrame:
    """Usable responses → one validated row per theme (``theme_pos`` = position after skipping falsy entries)."""
    return flatten_insights(validate_insights(responses))


def validated_strengths(responses: DataFrame) -> DataFrame:
    """Usable responses → (agent, strengths); a non-list becomes []."""
    return validate_insights(responses).select("agent", "strengths")


def flatten_insights(insights: DataFrame) -> DataFrame:
    """Nested insights → flat theme rows with ``theme_pos`` (0-based list position)."""
    # The outer form, filtered afterwards: for the plain one Spark adds a test of the list's size that evaluates the list again.
    return insights.select("agent", F.posexplode_outer("coaching_themes").alias("theme_pos", "t")).where("theme_pos IS NOT NULL").select(
        "agent",
        F.col("theme_pos").cast("int").alias("theme_pos"),
        "t.theme",
        "t.priority",
        "t.frequency",
        "t.examples",
        "t.recommendation",
    )


def merge_insights(old: DataFrame, new: DataFrame) -> DataFrame:
    """Right-biased merge by agent: the rows of an agent in ``new`` replace its rows in ``old``.

    One aggregation instead of a join, so either side is read once; an agent's
    rows of the winning side are few (its responses of one run).
    """
    columns = [c for c in new.columns if c != "agent"]
    tagged = old.select("agent", F.lit(0).alias("run"), *columns).unionByName(new.select("agent", F.lit(1).alias("run"), *columns))
    per_run = tagged.groupBy("agent", "run").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    winner = per_run.groupBy("agent").agg(F.max_by("rows", "run").alias("rows"))
    return winner.select("agent", F.inline("rows")).select(*new.columns)


def attach_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request with its response; requests that failed (none came back, or not a usable one) are dropped.

    Every response is judged by itself: of an agent with a usable and a failed one, the usable one is attached.
    """
    usable = parse_insights(responses, carry=tuple(responses.columns)).where(F.col("status") == "ok")
    return requests.join(usable.select(*responses.columns), "agent")
