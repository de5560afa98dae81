"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only when it was counted and has at most this many (id) rows.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker's memory does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary folder in local mode, and an
    error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() has written, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c) -> F.Column:
    """A-Z only: lower() would also fold other alphabets."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def fold(doc_id, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def _by_key(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    ids = stored(ids.distinct(), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge"), key, how)


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids. ids is counted: up to BROADCAST_ROWS it is broadcast and df stays
    where it is, beyond that both are shuffled."""
    return _by_key(df, ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in ids, or null; joined as in semi()."""
    return _by_key(df, ids, key, "left_anti")
