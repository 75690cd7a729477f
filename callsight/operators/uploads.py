"""What is kept of each upload, so that adding one file reads that file alone.

A dataset is the turns of several uploads. Its fingerprint and its distinct
counts are taken from one small row per upload: number, sum and exclusive or
of the row hashes (they add up to the fingerprint of the whole, exactly), and
mergeable sketches of the call ids and agents. The rows are kept in a versioned
store, a key per upload; loading an upload again replaces its row.

Counts from sketches are estimates: with ``LOG_SIZE`` 14 their relative standard
error is 0.65 % for large uploads, and small counts are exact in practice. The
exact counts (``agents.total_calls`` and others) stay the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.operators import sessions as K
from callsight.operators import versions

#: Binary logarithm of a sketch's size in buckets.
LOG_SIZE = 14
STATE = "columns string, n bigint, s decimal(38,0), x bigint, calls binary, agents binary"


def upload_state(turns: DataFrame) -> DataFrame:
    """One row (STATE) that says all of an upload's turns that fingerprints and counts need, in one pass."""
    sketch = lambda c: F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LOG_SIZE))
    return K.hashed_rows(turns, "call_id", "agent").agg(
        *K.hash_sums(), sketch("call_id").alias("calls"), sketch("agent").alias("agents")
    ).select(F.lit(",".join(turns.columns)).alias("columns"), "n", "s", "x", "calls", "agents")


def add_upload(turns: DataFrame, path: str, upload: str) -> None:
    """Keeps the state of an upload under its name; only ``turns`` is read."""
    versions.put(upload_state(turns), path, upload)


def merged_state(spark: SparkSession, path: str) -> DataFrame:
    """One row (STATE) for all uploads together; uploads with other columns cannot be merged, and are an error."""
    states = versions.stored(spark, path, STATE)
    one = F.when(F.min("columns") != F.max("columns"), F.raise_error(F.lit("uploads with different columns")).cast("string")).otherwise(F.max("columns"))
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).cast("decimal(38,0)").alias("s"), F.coalesce(F.expr("bit_xor(x)"), F.lit(0)).alias("x")]
    return states.agg(one.alias("columns"), *sums, F.hll_union_agg("calls").alias("calls"), F.hll_union_agg("agents").alias("agents"))


def stored_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """``sessions.dataset_fingerprint`` of all uploads together, from their states."""
    return K.fingerprint_of(merged_state(spark, path))


def estimated_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: turns (exact), and estimates of the different calls and agents over all uploads."""
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).cast("bigint")
    return merged_state(spark, path).select(
        F.col("n").alias("total_messages"), estimate("calls").alias("total_calls"), estimate("agents").alias("total_agents")
    )
