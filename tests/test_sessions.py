"""Session store: idempotent saves, fingerprints that look like numbers, newest-session choice."""

from pyspark.sql import functions as F

from callsight.operators import sessions as K
from callsight.session import scratch_path

INSIGHTS = K.INSIGHTS


def _ins(spark, agents):
    return spark.createDataFrame([(a, [(f"t-{a}", "high", 1, [], "r")], ["s"]) for a in agents], INSIGHTS)


def test_saving_a_session_twice_keeps_one_copy(spark):
    path = scratch_path(spark, "sessions-test")
    K.save_session(_ins(spark, ["a", "b"]), path, "abc123def456", "2025-02-07 12:00:00", "m")
    K.save_session(_ins(spark, ["a", "b"]), path, "abc123def456", "2025-02-07 12:00:00", "m")  # re-run
    K.save_session(_ins(spark, ["a"]), path, "abc123def456", "2025-02-07 13:00:00", "m")
    rows = K.list_sessions(spark, path, None).collect()
    assert [(str(r.session_ts), r.n_agents) for r in rows] == [("2025-02-07 13:00:00", 1), ("2025-02-07 12:00:00", 2)]
    assert [r.agent for r in K.latest_session(spark, path, "abc123def456").collect()] == ["a"]


def test_digit_only_fingerprint_stays_text(spark):
    path = scratch_path(spark, "sessions-test")
    for fh in ("012345678901", "1234e5678901"):
        K.save_session(_ins(spark, ["x"]), path, fh, "2025-02-07 12:00:00", "m")
    s = K.read_sessions(spark, path)
    assert dict(s.dtypes)["file_hash"] == "string"
    assert sorted(r.file_hash for r in s.select("file_hash").collect()) == ["012345678901", "1234e5678901"]
    assert K.latest_session(spark, path, "012345678901").count() == 1
    # The session's key reaches the file listing as a partition filter.
    plan = K.latest_session(spark, path, F.lit("012345678901"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key" in plan


def test_delete_removes_only_that_session(spark):
    path = scratch_path(spark, "sessions-test")
    K.save_session(_ins(spark, ["a", "b"]), path, "feedfeedfeed", "2025-02-07 12:00:00", "m")
    K.save_session(_ins(spark, ["c"]), path, "feedfeedfeed", "2025-02-07 13:00:00", "m")
    K.save_session(_ins(spark, ["d"]), path, "beefbeefbeef", "2025-02-07 12:00:00", "m")
    kept = K.delete_session(spark, path, F.lit("feedfeedfeed"), "2025-02-07 12:00:00")
    assert sorted(r.agent for r in kept.collect()) == ["c", "d"]


def test_fingerprint_is_stable_with_repeated_call_ids(spark):
    schema = "call_id string, agent string, turn_idx int, timestamp string, speaker string, message string, sentiment_score double"
    rows = [("C1", f"a{i % 3}", 0, "t", "agent", f"m{i}", None) for i in range(150)]

    def reordered(step):  # the same rows in another order
        return [r for k in range(step) for r in rows[k::step]]

    hashes = {
        K.dataset_fingerprint(spark.createDataFrame(reordered(step), schema).repartition(n)).first()[0]
        for step, n in ((1, 1), (1, 7), (2, 3), (3, 5), (7, 2))
    }
    assert len(hashes) == 1
    # Rows past the first hundred count, and so does a repeated one.
    for other in ([*rows[:-1], ("C9", *rows[-1][1:])], [*rows, rows[-1]]):
        assert K.dataset_fingerprint(spark.createDataFrame(other, schema)).first()[0] not in hashes
    first = lambda r: K.dataset_fingerprint(spark.createDataFrame(r, schema), first_rows=100).first()[0]
    assert first(rows) == first(rows[:149]) not in hashes


def _failing(df):
    """The same rows, where one task fails after others have written theirs."""
    broken = F.when(F.col("agent") == "z", F.raise_error(F.lit("stopped half way")).cast("string")).otherwise(F.col("agent"))
    return df.repartition(8, "agent").withColumn("agent", broken)


def test_a_write_that_dies_keeps_the_old_session(spark):
    import pytest

    path = scratch_path(spark, "sessions-test")
    assert K.list_sessions(spark, path).count() == 0 and K.latest_session(spark, path, "h").count() == 0
    K.save_session(_ins(spark, ["a", "b"]), path, "h", "2025-02-07 12:00:00", "m")
    with pytest.raises(Exception, match="half way"):
        K.save_session(_failing(_ins(spark, [*"acdefg", "z"])), path, "h", "2025-02-07 12:00:00", "m2")
    with pytest.raises(Exception, match="half way"):
        K.save_session(_failing(_ins(spark, ["z"])), path, "h", "2025-02-07 14:00:00", "m2")
    assert [(r.n_agents, r.model_used) for r in K.list_sessions(spark, path).collect()] == [(2, "m")]
    assert sorted(r.agent for r in K.latest_session(spark, path, "h").collect()) == ["a", "b"]


def test_a_cache_write_that_dies_keeps_the_old_table(spark):
    import pytest

    from callsight.operators import exports as E, versions

    path = scratch_path(spark, "cache-test")
    assert E.read_cache(spark, path).count() == 0
    made = lambda agents: spark.createDataFrame([(a, "t", "high", 1, "[]", "r", "now", "m") for a in agents], E.CACHE_SCHEMA)
    E.write_cache(made("ab"), path)
    reader = E.read_cache(spark, path)
    with pytest.raises(Exception, match="half way"):
        E.write_cache(_failing(made("cdefgz")), path)
    assert sorted(r.agent for r in E.read_cache(spark, path).collect()) == ["a", "b"]
    E.write_cache(made("xy"), path)
    assert sorted(r.agent for r in E.read_cache(spark, path).collect()) == ["x", "y"]
    assert sorted(r.agent for r in reader.select("agent").collect()) in (["a", "b"], ["x", "y"])  # never a mixture
    E.write_cache(made(""), path)
    assert E.read_cache(spark, path).count() == 0
    assert versions.remove_unused(spark, path) >= 2 and E.read_cache(spark, path).count() == 0


def test_listing_opens_no_data_file(spark):
    path = scratch_path(spark, "sessions-test")
    K.save_session(_ins(spark, ["a", "b"]), path, "h", "2025-02-07 12:00:00", "m")
    assert "/data" not in K.list_sessions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert all("/log/" in f for f in K.list_sessions(spark, path).inputFiles())


def test_unused_folders_go_and_live_ones_stay(spark):
    from callsight.operators import versions

    path = scratch_path(spark, "sessions-test")
    for ts in ("12", "12", "13"):
        K.save_session(_ins(spark, ["a", ts]), path, "h", f"2025-02-07 {ts}:00:00", "m")
    K.delete_session(spark, path, "h", "2025-02-07 13:00:00")
    assert versions.remove_unused(spark, path) == 2
    assert sorted(r.agent for r in K.read_sessions(spark, path).collect()) == ["12", "a"]
