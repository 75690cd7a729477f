"""Structured Streaming parse: a restart resumes from its checkpoint and adds only new files."""

from pyspark.sql import functions as F

from callsight.operators import transcripts as P
from callsight.plans import catalog
from callsight.session import scratch_path
from callsight.sources import files as Y
from callsight.streaming.turns import stream_turns

from .conftest import SMALL


def test_restart_adds_only_new_files(spark):
    calls = catalog.calls(spark, SMALL)
    first = calls.where(F.col("call_id") < "C000010")
    second = calls.where(F.col("call_id") >= "C000010")
    src, out, ckpt = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    Y.write_parquet(first, src + "/part=1")
    n1 = stream_turns(spark, src + "/*", out, ckpt).count()
    assert n1 == P.parse_turns(first).count() > 0
    assert stream_turns(spark, src + "/*", out, ckpt).count() == n1  # nothing new: no duplicates
    Y.write_parquet(second, src + "/part=2")
    got = stream_turns(spark, src + "/*", out, ckpt)
    expect = P.parse_turns(calls)
    assert got.count() == expect.count()
    assert got.exceptAll(expect).count() == 0 and expect.exceptAll(got).count() == 0
