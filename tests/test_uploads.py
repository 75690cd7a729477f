"""States of uploads: fingerprints and counts of the whole from what is kept of each part."""

import pytest
from pyspark.sql import functions as F

from callsight.operators import sessions as K
from callsight.operators import uploads as U
from callsight.operators import versions
from callsight.session import scratch_path

SCHEMA = "call_id string, agent string, turn_idx int, timestamp string, speaker string, message string, sentiment_score double"


def turns(spark, first, stop, agents=7):
    return spark.createDataFrame([(f"c{i // 4}", f"a{i % agents}", i % 4, "t", "agent", f'm,"{i}', i / 8) for i in range(first, stop)], SCHEMA)


def test_fingerprint_of_parts_is_that_of_the_whole(spark):
    path = scratch_path(spark, "uploads-test")
    assert U.stored_fingerprint(spark, path).count() == 1  # of nothing
    for name, a, b in (("x", 0, 90), ("y", 90, 91), ("z", 91, 400), ("none", 0, 0)):
        U.add_upload(turns(spark, a, b), path, name)
    whole = K.dataset_fingerprint(turns(spark, 0, 400)).first()[0]
    assert U.stored_fingerprint(spark, path).first()[0] == whole
    U.add_upload(turns(spark, 0, 90).repartition(5), path, "x")  # loaded again
    assert U.stored_fingerprint(spark, path).first()[0] == whole
    U.add_upload(turns(spark, 0, 89), path, "x")  # and with a row less
    assert U.stored_fingerprint(spark, path).first()[0] == K.dataset_fingerprint(turns(spark, 0, 89).union(turns(spark, 90, 400))).first()[0] != whole
    versions.take_away(spark, path, "x")
    assert U.stored_fingerprint(spark, path).first()[0] == K.dataset_fingerprint(turns(spark, 90, 400)).first()[0]


def test_merging_reads_no_turn(spark):
    path = scratch_path(spark, "uploads-test")
    U.add_upload(turns(spark, 0, 50), path, "x")
    for df in (U.stored_fingerprint(spark, path), U.estimated_counts(spark, path)):
        assert all("/uploads-test" in f for f in df.inputFiles())


def test_estimates_within_the_bound(spark):
    path = scratch_path(spark, "uploads-test")
    n = 60_000
    made = spark.range(n).selectExpr("concat('c', id) AS call_id", "concat('a', id % 20000) AS agent", "0 AS turn_idx")
    for i in range(3):  # the parts overlap: a call of two uploads is one call
        U.add_upload(made.where(F.substring("call_id", 2, 9).cast("int") % 4 >= i), path, f"u{i}")
    r = U.estimated_counts(spark, path).first()
    error = 4 * 0.0065
    assert abs(r.total_calls - n) < error * n and abs(r.total_agents - 20_000) < error * 20_000
    assert r.total_messages == n + n * 3 // 4 + n // 2
    small = scratch_path(spark, "uploads-test")
    U.add_upload(turns(spark, 0, 100), small, "x")
    assert tuple(U.estimated_counts(spark, small).first()) == (100, 25, 7)


def test_uploads_with_other_columns_are_an_error(spark):
    path = scratch_path(spark, "uploads-test")
    U.add_upload(turns(spark, 0, 5), path, "x")
    U.add_upload(turns(spark, 0, 5).drop("message"), path, "y")
    with pytest.raises(Exception, match="different columns"):
        U.stored_fingerprint(spark, path).collect()
