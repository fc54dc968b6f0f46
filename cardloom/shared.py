"""Session helpers every operator uses: table access, lineage cuts in the shared folder, parallelism."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and all tasks run in this process
    (a local master, as in tests) one of our own; on a cluster there is no folder to fall back to.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    return path


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(spark: SparkSession, path: str) -> bool:
    """Whether a job's output is complete."""
    at, files = _path(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def version(spark: SparkSession, path: str) -> str:
    """What tells one state of a stored table from another: its files' count, size and latest change."""
    at, files = _path(spark, path)
    if not files.exists(at):
        return "none"
    found = [files.getFileStatus(at)] if files.getFileStatus(at).isFile() else list(files.listStatus(at))
    return f"{len(found)}-{sum(f.getLen() for f in found)}-{max((f.getModificationTime() for f in found), default=0)}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df once to the shared folder and go on from the written copy.

    The copy survives lost executors and is read instead of being computed again.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
