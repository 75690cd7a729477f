"""The scratch folder: named by the cluster, or an error; its own only in a local session."""

import pytest

from callsight import session


class _Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master, conf=None):
        self.sparkContext, given = _Context(master), conf or {}
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: given.get(key, default))})


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(_Session(master))
    named = _Session(master, {"spark.checkpoint.dir": "hdfs:///shared"})
    assert session.ensure_checkpoint_dir(named) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_has_its_own(master):
    assert session.ensure_checkpoint_dir(_Session(master))


def test_queries_run_again_after_scratch_is_removed_and_see_changed_tables(spark, tmp_path):
    from callsight.plans import catalog
    from callsight.session import remove_scratch

    def table(n):
        spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").filter(f"conv_id < {n}").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")

    count = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).count()
    table(6)
    few = {name: count(name) for name in ("register_turns", "call_digest_wide")}
    remove_scratch(spark)
    assert {name: count(name) for name in few} == few
    table(9)
    assert all(count(name) > few[name] > 0 for name in few)
