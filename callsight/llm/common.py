"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, under fixed names, so that no other column can clash with an operator's own."""
    return shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after the session's Python workers were given this package (as ``--py-files`` would), so that they can import it.

    Rows hold whole texts: where the session has Spark's default number of rows a batch, it is lowered.
    """
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if conf.get(BATCH) == "10000":
        conf.set(BATCH, "2000")
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"  # the driver's own; Spark hands it out
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return df
