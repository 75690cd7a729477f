"""Distributed global ordinals (1..n in a total order) without a one-task window.

``row_number()`` over an unpartitioned window moves every row into a single
task. Instead the rows are range-partitioned on the order keys (sampled
bounds), sorted inside each partition, numbered with the per-partition
counter of ``monotonically_increasing_id``, and shifted by the running count
of the preceding partitions. The offset table has one row per partition, so
it is bounded by the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = (1 << 33) - 1


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def with_global_ordinal(
    df: DataFrame, order: list[Column], name: str = "ordinal", num_partitions: int | None = None
) -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order`` (a total order: make it unique).

    The range-partitioned, sorted input is checkpointed (reliable checkpoint
    in the shared checkpoint folder) so the partition layout and the offsets
    are computed from the same materialised rows, also after an executor loss.
    """
    n = _num_partitions(df, num_partitions)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ranged.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    tagged = tagged.checkpoint(eager=True)
    offsets = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    )  # one row per partition
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.select(
        *[c for c in df.columns],
        (F.coalesce(F.col("_off"), F.lit(0)) + (F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))) + 1)
        .cast("bigint")
        .alias(name),
    )
