"""Structured Streaming form of transcript parsing.

Parsing is stateless per call row, so the batch operator runs unchanged on a
stream: ``readStream`` of call files → ``parse_turns`` → a Parquet sink with a
checkpoint in the shared folder. ``availableNow`` processes what is there and
stops, which suits scheduled incremental loads; a restart resumes from the
checkpoint, so a lost executor or driver does not duplicate output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callsight.operators.transcripts import parse_turns
from callsight.sources.files import CALLS_SCHEMA


def stream_turns(
    spark: SparkSession, calls_dir: str, out_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 1000
) -> DataFrame:
    """Run the calls→turns stream once over the files present (availableNow) and return the sink table."""
    calls = spark.readStream.schema(CALLS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(calls_dir)
    q = (
        parse_turns(calls)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out_dir)
