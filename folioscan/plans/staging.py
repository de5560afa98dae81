"""Stages between steps: a frame written once to the folder that all executors share, and read from there. The next step's plan
starts at a scan, however long the way to it was, and a lost executor costs a task."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        local = master.startswith("local") and "cluster" not in master
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/folioscan-stages"
    return found.rstrip("/")


_folders: set[str] = set()


def _clear(spark: SparkSession, folder: str) -> None:
    """Deletes a session's stages when the interpreter ends."""
    with contextlib.suppress(Exception):  # the session's JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh place below the application's own folder, which goes when the interpreter ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as Parquet, in folders by the values of a column if asked, whose filters then prune folders."""
    path = stage_path(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
