"""Test inputs derived from the driver's tables (see FIXTURES.md).

F1 turns calls out of ``conversations``; F3 turns ``documents`` into coaching
theme rows. Both are pure arithmetic on the source columns, so the row count
grows with the tables and DuckDB can compute the same expectations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.functions.text import pad_left
from callsight.operators.themes import theme_lexicon


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def turns_source(conversations: DataFrame) -> DataFrame:
    """F1 ``turns_src``: call keys, injected markup/PII body and the expected clean text."""
    conv = F.col("conv_id")
    agent_no = (
        F.when(conv % 10 == 9, F.lit(100) + F.floor(conv / 90.0).cast("int"))
        .otherwise(((conv % 10) % 8).cast("int"))
    )
    turn5 = F.col("turn") % 5
    body_prefix = (
        F.when(turn5 == 0, F.lit("mail a.b7@mail.example.com<br/>now "))
        .when(turn5 == 1, F.lit("dial 555-123-4567 "))
        .when(turn5 == 2, F.lit("ssn <b>123-45-6789</b> "))
        .when(turn5 == 3, F.lit("card 4111 1111 1111 1111 "))
        .otherwise(F.lit(""))
    )
    clean_prefix = (
        F.when(turn5 == 0, F.lit("mail [EMAIL_REDACTED] now "))
        .when(turn5 == 1, F.lit("dial [PHONE_REDACTED] "))
        .when(turn5 == 2, F.lit("ssn [SSN_REDACTED] "))
        .when(turn5 == 3, F.lit("card [CARD_REDACTED] "))
        .otherwise(F.lit(""))
    )
    role = F.col("role")
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .withColumn("agent_no", agent_no)
        .select(
            "conv_id",
            "turn",
            F.concat(F.lit("C"), pad_left(conv, 6)).alias("call_id"),
            F.concat(F.lit("Agent "), pad_left(F.col("agent_no"), 3)).alias("agent"),
            F.when((F.col("agent_no") == 3) | (conv % 11 == 0), F.lit(None).cast("double"))
            .otherwise(((conv * 37) % 51).cast("double") / 10)
            .alias("sentiment_score"),
            F.when(role == "assistant", "Agent").when(role == "user", "Customer").otherwise("System").alias("speaker_label"),
            F.when(role == "assistant", "agent").when(role == "user", "customer").otherwise("system").alias("speaker"),
            F.concat(body_prefix, F.col("text")).alias("body"),
            F.concat(clean_prefix, F.col("text")).alias("clean"),
        )
    )


def calls_from_conversations(conversations: DataFrame) -> DataFrame:
    """F1 ``calls``: even conversations in bracket form, odd ones in pipe form.

    One row per conversation; the turns of one conversation are ordered with
    ``array_sort`` on (turn, line) and joined. The group is one call, which is
    one transcript value in the data model, so its size is that of a call.
    """
    src = turns_source(conversations)
    conv = F.col("conv_id")
    mm = pad_left(conv % 60, 2)
    ss = pad_left(F.col("turn"), 2)
    bracket_line = F.concat(
        F.lit("[12:"), mm, F.lit(":"), ss, F.lit(" "), F.upper(F.col("speaker_label")), F.lit("]:\n"), F.col("body")
    )
    pipe_line = F.concat(
        F.lit("2025-02-07 13:"), mm, F.lit(":"), ss, F.lit(" +0000 "), F.col("speaker_label"), F.lit(": "), F.col("body")
    )
    lines = src.select(
        "conv_id",
        "call_id",
        "agent",
        "sentiment_score",
        F.struct(F.col("turn"), F.when(conv % 2 == 0, bracket_line).otherwise(pipe_line).alias("line")).alias("tl"),
    )
    grouped = lines.groupBy("conv_id", "call_id", "agent", "sentiment_score").agg(
        F.array_sort(F.collect_list("tl")).alias("tls")
    )
    return grouped.select(
        "call_id",
        "agent",
        F.when(F.col("conv_id") % 2 == 0, F.array_join(F.transform("tls", lambda x: x["line"]), "\n"))
        .otherwise(F.array_join(F.transform("tls", lambda x: x["line"]), " | "))
        .alias("transcript"),
        "sentiment_score",
    )


def theme_rows_from_documents(documents: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """F3 flat coaching themes: agent, theme_pos, theme, priority, frequency, examples, recommendation."""
    lex = lexicon if lexicon is not None else theme_lexicon(documents.sparkSession)
    d = F.col("doc_id")
    r = d % 21
    block = F.floor(d / 21.0).cast("bigint")
    agent_no = block * 6 + (
        F.when(r < 1, 0).when(r < 3, 1).when(r < 6, 2).when(r < 10, 3).when(r < 15, 4).otherwise(5)
    )
    theme_pos = F.when(r < 1, 0).when(r < 3, r - 1).when(r < 6, r - 3).when(r < 10, r - 6).when(r < 15, r - 10).otherwise(
        r - 15
    )
    docs = documents.select(
        "doc_id",
        "n_chars",
        "text",
        ((d * 7 + F.floor(d / 30.0).cast("bigint")) % 30).cast("int").alias("theme_ord"),
        agent_no.alias("agent_no"),
        theme_pos.cast("int").alias("theme_pos"),
    )
    lex_small = F.broadcast(lex.select("theme_ord", F.col("theme").alias("lex_theme")))  # fixed 30 rows
    j = docs.join(lex_small, "theme_ord")
    theme = (
        F.when(d % 23 == 0, F.concat(F.lit("Custom theme "), (d % 5).cast("string")))
        .when(d % 19 == 0, F.lower(F.col("lex_theme")))
        .when(d % 13 == 0, F.concat(F.col("lex_theme"), F.lit(" skills")))
        .otherwise(F.col("lex_theme"))
    )
    prio = F.when((d * 5) % 3 == 0, "high").when((d * 5) % 3 == 1, "medium").otherwise("low")
    return j.select(
        F.concat(F.lit("Agent "), pad_left(F.col("agent_no"), 5)).alias("agent"),
        "theme_pos",
        theme.alias("theme"),
        prio.alias("priority"),
        (F.col("n_chars") % 7).cast("bigint").alias("frequency"),
        # Some carry a whole document: quotes, line breaks, long texts, letters outside ASCII.
        F.when(d % 7 == 0, F.array(F.concat(F.lit("Example from document "), d.cast("string")), F.col("text")))
        .otherwise(F.array(F.concat(F.lit("Example from document "), d.cast("string"))))
        .alias("examples"),
        F.concat(
            F.lit("Practise "), F.col("lex_theme"), F.lit(" in call "), d.cast("string"),
            F.when(d % 5 == 0, F.concat(F.lit(': "'), F.col("text"), F.lit('" \\ \t end'))).otherwise(F.lit("")),
        ).alias("recommendation"),
    )


def previous_session_agents(turns_or_calls: DataFrame) -> DataFrame:
    """Agents recorded by an earlier session in tests: the even-numbered F1 agents."""
    return (
        turns_or_calls.select("agent")
        .where(F.col("agent").isNotNull())
        .distinct()
        .where(F.substring(F.col("agent"), -1, 1).cast("int") % 2 == 0)
    )


def agent_number() -> Column:
    """The number in an F3 agent name, however long it is."""
    return F.expr("cast(substring(agent, 7) AS bigint)")


RESPONSE_CLASSES = 8  # agent number modulo 8 picks how the response is damaged


def insights_from_theme_rows(theme_rows: DataFrame) -> DataFrame:
    """Nested insights per agent from flat F3 rows (≤ 6 themes per agent by construction)."""
    g = theme_rows.groupBy("agent").agg(
        F.array_sort(
            F.collect_list(F.struct("theme_pos", "theme", "priority", "frequency", "examples", "recommendation"))
        ).alias("t")
    )
    agent_no = agent_number()
    return g.select(
        "agent",
        F.transform(
            "t",
            lambda x: F.struct(
                x["theme"].alias("theme"),
                x["priority"].alias("priority"),
                x["frequency"].alias("frequency"),
                x["examples"].alias("examples"),
                x["recommendation"].alias("recommendation"),
            ),
        ).alias("coaching_themes"),
        F.array(F.concat(F.lit("Strength "), (agent_no % 3).cast("string"))).alias("strengths"),
    )


def responses_from_theme_rows(theme_rows: DataFrame) -> DataFrame:
    """Model-response envelopes per F3 agent; the class (agent number % 8) decides the damage.

    0 ok, 1 fenced, 2 error envelope, 3 no choices, 4 truncated JSON, 5 a JSON list,
    6 priority 'urgent' and frequency as text, 7 no response.
    """
    ins = insights_from_theme_rows(theme_rows)
    cls = agent_number() % RESPONSE_CLASSES
    plain = F.to_json(F.struct("coaching_themes", "strengths"))
    odd = F.to_json(
        F.struct(
            F.transform(
                "coaching_themes",
                lambda x: F.struct(
                    x["theme"].alias("theme"),
                    F.lit("urgent").alias("priority"),
                    x["frequency"].cast("string").alias("frequency"),
                    x["examples"].alias("examples"),
                    x["recommendation"].alias("recommendation"),
                ),
            ).alias("coaching_themes"),
            F.col("strengths"),
        )
    )
    content = (
        F.when(cls == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(cls == 4, F.expr("substring(to_json(struct(coaching_themes, strengths)), 1, length(to_json(struct(coaching_themes, strengths))) - 1)"))
        .when(cls == 5, F.lit("[]"))
        .when(cls == 6, odd)
        .otherwise(plain)
    )
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    response = (
        F.when(cls == 2, F.lit('{"error": "HTTP 429: slow down"}'))
        .when(cls == 3, F.concat(F.lit('{"id": '), cls.cast("string"), F.lit("}")))
        .when(cls == 7, F.lit(None).cast("string"))
        .otherwise(envelope)
    )
    return ins.select("agent", response.alias("response"))


def questions_from_agents(theme_rows: DataFrame) -> DataFrame:
    """F7 questions, one per F3 agent: the template is picked by agent number % 8."""
    agents = theme_rows.select("agent").distinct()
    no = agent_number()
    k = no % 8
    q = (
        F.when(k == 0, F.lit("What are the top themes?"))
        .when(k == 1, F.concat(F.lit("How should "), F.col("agent"), F.lit(" improve?")))
        .when(k == 2, F.lit("How many calls are there?"))
        .when(k == 3, F.lit("How many agents are there?"))
        .when(k == 4, F.lit("What is the average sentiment?"))
        .when(k == 5, F.lit("List all supervisors"))
        .when(k == 6, F.lit("Why did Monday go badly?"))
        .otherwise(F.concat(F.lit("Which coaching theme fits "), F.lower(F.col("agent")), F.lit(" best?")))
    )
    return agents.select(no.alias("question_id"), q.alias("question"))
