"""Flat export tables from insights (CSV rows, summary/detail sheets, coaching cache)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.operators import versions

# Fixed values that must equal the reference's export defaults.
EXAMPLES_SEPARATOR = " | "


def coaching_cache(theme_rows: DataFrame, processed_at: str, model_used: str) -> DataFrame:
    """Cache table: one row per theme with run stamp; ``examples`` as JSON text."""
    return theme_rows.select(
        "agent",
        "theme",
        "priority",
        F.coalesce(F.col("frequency"), F.lit(1)).cast("bigint").alias("frequency"),
        F.to_json(F.coalesce("examples", F.array().cast("array<string>"))).alias("examples"),
        "recommendation",
        F.lit(processed_at).alias("processed_at"),
        F.lit(model_used).alias("model_used"),
    )


CACHE_SCHEMA = "agent string, theme string, priority string, frequency bigint, examples string, recommendation string, processed_at string, model_used string"


def write_cache(cache: DataFrame, path: str) -> None:
    """Replaces the stored cache table with this run's rows, in one step: a write that fails leaves the old table."""
    versions.put(cache, path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last cache that was written whole; none before the first."""
    return versions.stored(spark, path, CACHE_SCHEMA, "table").drop("key", "version")


def export_theme_rows(theme_rows: DataFrame) -> DataFrame:
    """CSV export rows: examples joined by ' | ', missing values defaulted."""
    return theme_rows.select(
        "agent",
        F.coalesce("theme", F.lit("Unknown")).alias("theme"),
        F.coalesce("priority", F.lit("low")).alias("priority"),
        F.coalesce(F.col("frequency"), F.lit(0)).cast("bigint").alias("frequency"),
        F.array_join(F.coalesce("examples", F.array().cast("array<string>")), EXAMPLES_SEPARATOR).alias("examples"),
        F.coalesce("recommendation", F.lit("")).alias("recommendation"),
    )


def export_summary(theme_rows: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Summary sheet: per agent calls that went to review, number of themes, number of high-priority themes.

    ``agents(agent, calls_analyzed)`` gives the counts and the agents without themes; without it calls are 0.
    """
    c = theme_rows.groupBy("agent").agg(
        F.count(F.lit(1)).cast("bigint").alias("coaching_themes"),
        F.sum(F.when(F.col("priority") == "high", 1).otherwise(0)).cast("bigint").alias("high_priority"),
    )
    if agents is not None and "calls_analyzed" in agents.columns:
        base = agents.select("agent", F.col("calls_analyzed").cast("bigint").alias("calls"))
        return base.join(c, "agent", "full_outer").fillna(0, ["calls", "coaching_themes", "high_priority"]).select("agent", "calls", "coaching_themes", "high_priority")
    return c.select("agent", F.lit(0).cast("bigint").alias("calls"), "coaching_themes", "high_priority")


def export_details(theme_rows: DataFrame) -> DataFrame:
    """Detail sheet: agent, theme, priority, frequency, recommendation."""
    return theme_rows.select("agent", "theme", "priority", "frequency", "recommendation")


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV with RFC-4180 quoting (quotes doubled), as spreadsheet tools expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
