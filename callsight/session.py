"""Session helpers: local sessions for tests and benches, shared scratch paths.

Operators never build a session themselves; they take DataFrames. These
helpers exist for tests, ``bench.py`` and the query catalogue.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "callsight") -> SparkSession:
    """A local session configured the way the library expects a cluster to be."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Python's json keeps the last of duplicate keys; VARIANT parsing does the same with this flag.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", os.environ.get("CALLSIGHT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only when the cluster named none."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext; the server owns the folder
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder for checkpoints and scratch tables")
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share; only a local[...] session may use its own disk")
        conf_dir = tempfile.mkdtemp(prefix="callsight-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


_scratch: list[str] = []
_forget: list[Callable[[], None]] = []


def when_removed(forget: Callable[[], None]) -> None:
    """Has ``forget`` called when scratch tables go: for whoever remembers the path of one."""
    _forget.append(forget)


def remove_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this process, when no result that reads them is needed any more, and what remembers them."""
    for forget in _forget:
        forget()
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def table_version(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: changes when the table does."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(folder)
    return ";".join(sorted(f"{x.getPath().getName()} {x.getLen()} {x.getModificationTime()}" for x in found))
