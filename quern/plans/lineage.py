"""Cutting lineage with a table written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on a local master where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already; the folder's owner cleans it
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    A lost executor then costs a re-read, not a recomputation, and iterative plans stay short. Unlike ``checkpoint()``
    the last stage runs once and the files are columnar and compressed. The table is removed when the session ends, or by
    ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``cut_lineage`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        if path := getattr(df, "_cut_at", None):
            _remove(df.sparkSession, path)
