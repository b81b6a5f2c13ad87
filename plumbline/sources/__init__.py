"""Where rows come from: parquet tables, and mines of Markdown, TSV and JSON files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Only a local master may leave that unset; then a folder of this machine is used.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "plumbline")
    return where if "://" in where else f"file://{where}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of df, written to a folder that all executors see and read back; cuts the lineage."""
    df.write.parquet(path)
    store, target = _place(df.sparkSession, path)
    store.deleteOnExit(target)  # at the latest
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    store, target = _place(spark, path)
    store.deleteOnExit(target)
    return path


def fresh_stored(df: DataFrame, shared: str, name: str) -> DataFrame:
    """The rows of df, written to a new folder under ``shared`` and read back."""
    return stored(df, f"{shared}/{name}-{uuid.uuid4().hex}")


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of stored rows that nothing reads any more."""
    store, target = _place(spark, path)
    store.delete(target, True)
