"""First or newest rows of each key.

Ranks are taken in a window per key with the filter directly above it, so Spark keeps only the first rows of each
key before the shuffle (WindowGroupLimit) and a hot key sends few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnframe.durable import written


def ranked(rows: DataFrame, keys: list, order: list, rank: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) within the key."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def numbered(rows: DataFrame, keys: list[str], order: list, rank: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) within the key, for keys that may hold any share of all rows.

    Rows are dealt to ranges of (key, order), as many as the session has shuffle partitions, and numbered there; the places before a range are added from one row for each
    (range, key).  The dealt rows are written out, since a second range shuffle may cut elsewhere.
    """
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    placed = written(dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))), "numbered")
    sizes = placed.groupBy("_range", *keys).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"))
    same = [F.col("_range") == F.col("_r"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return placed.join(starts, same).select(*rows.columns, (F.col("_from") + F.col("_n")).cast("long").alias(rank))


def first_k(rows: DataFrame, keys: list, order: list, k: int = 1, rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each key; every tie must be settled by ``order``."""
    kept = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
    return kept.drop(rank) if rank == "_rank" else kept.withColumn(rank, F.col(rank).cast("long"))


def keep_first(rows: DataFrame, key: list, order: list) -> DataFrame:
    """One row of each key: the earliest."""
    return first_k(rows, key, order, 1)


def dedup_long_text(rows: DataFrame, scope: list, text: Column, order: list, row_id: str) -> DataFrame:
    """The earliest row for each (scope, text), shuffling digests instead of texts; rows come back by their id."""
    keyed = rows.select(row_id, *scope, F.sha2(text, 256).alias("_digest"), *order)
    names = [c for c in keyed.columns if c not in (row_id, *scope, "_digest")]
    kept = keep_first(keyed, [*scope, "_digest"], [*names, row_id]).select(row_id)
    return rows.join(kept, row_id, "left_semi")
