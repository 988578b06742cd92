"""Tables staged in the shared folder of the cluster.

A result read more than once is written there as Parquet and read back, so later
scans prune columns, lineage ends, and a lost executor costs one re-read and no
recomputation. The folder is ``spark.checkpoint.dir``; only a local session may
go without it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a temporary one only in local mode."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tonegrain-")
    return _local_root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared root.

    Folders are grouped by application, to be cleared once it has ended.
    """
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/tonegrain/{app}/{name}-{uuid.uuid4().hex}"


def write_staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once; returns it as a Parquet scan, and its folder (an action)."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a Parquet scan (an action)."""
    return write_staged(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that no later plan reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
