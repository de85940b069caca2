"""Bounded samples that are the same in every run: the rows with the least hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes are numbers below this.
RANGE = 1 << 53


def hashed(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 11)


def least_hashed(rows: DataFrame, key: str, n: int, by: str) -> DataFrame:
    """At most ``n`` rows of each value of ``by``: those with the least hash of ``key`` (which is unique).

    A group of size s first loses what lies beyond twice the share n / s of all hashes, where its n least ones can't
    be (2n are expected below; for n >= 100 fewer than n happen about never), so that each task of the exact
    choice sees a few n rows, however large the group and however many partitions it came from.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("_size"))  # a row for each group
    limit = F.lit(2.0 * n * RANGE) / F.col("_size")
    near = rows.join(F.broadcast(sizes), by).where(hashed(key) < limit)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(hashed(key), key))
    return near.withColumn("_nth", nth).where(F.col("_nth") <= n).select(rows.columns)
