"""Tables that a stream changes: merge on read, compaction past a ratio.

A micro-batch writes its own rows alone, to ``<path>/change/v=<batch id>``.  A reader takes the newest base, ``<path>/base/v=<n>``,
and the changes after n, and merges them.  Once the changes since a base weigh more than ``ratio`` times the base, the batch that finds it
writes a new base.  So a poll writes in proportion to itself: over any number of polls, bases add at most ``1 + 1 / ratio``
times the bytes of the changes.

A batch that runs again after a failure writes the same change from the same rows; a base that it had already finished holds
that change.  What a base replaced goes when the next base is written, so readers have that long to finish.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame], DataFrame]
RATIO = 1.0


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, so any store works, and the maker of its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[int]:
    """Completed versions under a path, rising."""
    fs, hadoop = files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))] if fs.exists(hadoop(path)) else []
    found = [re.fullmatch(r"v=(\d+)", n) for n in names]
    return sorted(int(m[1]) for m in found if m and fs.exists(hadoop(f"{path}/{m[0]}/_SUCCESS")))


def current(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest base (-1: none) and the changes after it."""
    base = max(versions(spark, f"{path}/base"), default=-1)
    return base, [v for v in versions(spark, f"{path}/change") if v > base]


def size(spark: SparkSession, path: str) -> int:
    fs, hadoop = files(spark, path)
    return fs.getContentSummary(hadoop(path)).getLength() if fs.exists(hadoop(path)) else 0


def read(spark: SparkSession, path: str, schema, merge: Merge) -> DataFrame:
    """The table: base and later changes, merged."""
    base, later = current(spark, path)
    parts = [f"{path}/base/v={base}"] * (base >= 0) + [f"{path}/change/v={v}" for v in later]
    return merge(spark.read.schema(schema).parquet(*parts)) if parts else spark.createDataFrame([], schema)


def change(rows: DataFrame, path: str, version: int, merge: Merge, ratio: float = RATIO) -> None:
    """Write a batch's rows, and a new base if the changes have grown past the ratio."""
    spark, schema = rows.sparkSession, rows.schema
    merge(rows).select(rows.columns).write.mode("overwrite").parquet(f"{path}/change/v={version}")
    base, later = current(spark, path)
    if sum(size(spark, f"{path}/change/v={v}") for v in later) <= ratio * size(spark, f"{path}/base/v={base}"):
        return
    read(spark, path, schema, merge).select(rows.columns).write.mode("overwrite").parquet(f"{path}/base/v={version}")
    fs, hadoop = files(spark, path)
    for kind, last in (("base", base - 1), ("change", base)):
        for v in versions(spark, f"{path}/{kind}"):
            if v <= last:
                fs.delete(hadoop(f"{path}/{kind}/v={v}"), True)
