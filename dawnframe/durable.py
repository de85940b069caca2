"""Lineage cuts that survive lost executors.

``written`` stores a frame as Parquet in the folder that the cluster names in ``spark.checkpoint.dir`` (every
executor and the driver see it) and reads it back.  Parquet rather than ``DataFrame.checkpoint()``: it is
columnar and compressed, so a later reader takes only the columns it needs.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


class _Made(threading.local):
    """Paths of the tables that ``written`` made in this thread and nobody has discarded, oldest first."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set (local tests) one of our own."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-dawnframe-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` computed once, kept in the shared folder and read back."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/dawnframe/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _MADE.paths.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def mark() -> int:
    """Where tables written from now on begin; for ``discard_since``."""
    return len(_MADE.paths)


def discard_since(spark: SparkSession, start: int) -> None:
    """Delete the tables this thread has written since a mark, but for the newest one; for a caller whose result no longer reads the others."""
    gone = _MADE.paths[start:-1]
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _MADE.paths[start : start + len(gone)]
