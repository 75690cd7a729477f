"""Stored tables whose replacement is one step: versioned folders and a small log.

A table written in place is gone while it is being replaced, and stays gone if
the writer dies. Here each write goes to a folder of its own, and becomes
visible by one row appended to a log, itself a small Parquet table that Spark
commits as one file. Readers look at the log first and read only the folders it
names. What a failed write left behind is in no log row, and so is never read;
``remove_unused`` deletes it, and the folders that later rows replaced.

A log row holds a key (text; what the folder holds), the folder, whether it was
put or taken away, the time, and a few values that listings need, so that these
open no data file.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, DATA = "log", "data"


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _text(c: Column | str) -> Column:
    return (F.lit(c) if isinstance(c, str) else c).cast("string")


def _append(spark: SparkSession, path: str, key: str, version: str, put: bool, values: dict[str, Column]) -> None:
    fields = [v.alias(k) for k, v in values.items()]
    row = spark.range(1).select(
        F.lit(key).alias("key"),
        F.lit(version).alias("version"),
        F.lit(put).alias("put"),
        F.lit(time.time_ns()).cast("bigint").alias("at"),
        (F.to_json(F.struct(*fields)) if fields else F.lit("{}")).alias("values"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{LOG}")


def put(df: DataFrame, path: str, key: str = "table", values: dict[str, Column] | None = None) -> None:
    """Writes ``df`` as the new version of ``key``; ``n_rows`` and ``values`` stand in the log.

    The old version is read until the last step, and for good if an earlier one fails.
    """
    spark, version = df.sparkSession, f"v{uuid.uuid4().hex[:16]}"
    folder = f"{path.rstrip('/')}/{DATA}/key={key}/version={version}"
    df.write.parquet(folder)
    n = spark.read.schema(df.schema).parquet(folder).count()  # from the files' footers
    _append(spark, path, key, version, True, {"n_rows": F.lit(n), **(values or {})})


def take_away(spark: SparkSession, path: str, key: str) -> None:
    """Has no version of ``key`` any more: one log row, no file is touched."""
    _append(spark, path, key, "", False, {})


def live(spark: SparkSession, path: str) -> DataFrame:
    """(key, version, values): the newest version of every key, off the log alone; empty where nothing was stored."""
    fs, folder = _hadoop(spark, f"{path.rstrip('/')}/{LOG}")
    schema = "key string, version string, put boolean, at bigint, `values` string"
    log = spark.read.schema(schema).parquet(str(folder)) if fs.exists(folder) else spark.createDataFrame([], schema)
    newest = log.groupBy("key").agg(F.max(F.struct("at", "version", "put", "values")).alias("m"))
    return newest.where("m.put").select("key", "m.version", "m.values")


def stored(spark: SparkSession, path: str, schema: str, key: Column | str | None = None) -> DataFrame:
    """(key, version, ...): the rows of every live version, or of ``key``'s; other folders are pruned before they are read."""
    fs, folder = _hadoop(spark, f"{path.rstrip('/')}/{DATA}")
    whole = f"{schema}, key string, version string"
    data = spark.read.schema(whole).parquet(str(folder)) if fs.exists(folder) else spark.createDataFrame([], whole)
    now = live(spark, path)
    if key is not None:
        data, now = data.where(F.col("key") == _text(key)), now.where(F.col("key") == _text(key))
    return data.join(now.select("key", "version"), ["key", "version"], "left_semi")


def remove_unused(spark: SparkSession, path: str) -> int:
    """Deletes the folders that no live version names; how many. Only when no write and no reader of an old version is under way."""
    fs, data = _hadoop(spark, f"{path.rstrip('/')}/{DATA}")
    if not fs.exists(data):
        return 0
    kept, gone = {(r["key"], r["version"]) for r in live(spark, path).select("key", "version").collect()}, 0  # a short row a key
    for of_key in fs.listStatus(data):
        for folder in fs.listStatus(of_key.getPath()):
            name = tuple(p.getName().split("=", 1)[1] for p in (of_key.getPath(), folder.getPath()))
            if name not in kept:
                fs.delete(folder.getPath(), True)
                gone += 1
    return gone
