"""As-of joins: for each row of one table the rows of another that stand next to it in time, by key.

Both tables are dealt together to ranges of (key, instant).  Inside a range the last row before and the first one after are
carried along by running windows, one in each direction; from range to range by one row for each (range, key).  So a key may
hold any share of all rows, and no row meets more than its two neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnframe.durable import written

LEFT, RIGHT = 1, 0  # at the same instant the other table's row comes first


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, fields: list[str]) -> DataFrame:
    """``left`` with structs (at, *fields): ``before``, the last row of ``right`` at or before ``at``, and ``after``, the first one later.

    Rows of ``right`` at one instant count as one, the least by ``fields``; those without an instant are left out.  A row of
    ``left`` without one, or without neighbours, has nulls.  A null key matches a null key.  ``keys`` may be empty: one series.
    """
    one = right.where(F.col(right_at).isNotNull()).groupBy(*[F.col(k) for k in keys], F.col(right_at).alias("_at")).agg(F.min(F.struct(*[F.col(c) for c in fields])).alias("_fields"))
    row = F.struct(F.col("_at").alias("at"), *[F.col(f"_fields.{c}").alias(c) for c in fields])
    names = [f"_k{i}" for i in range(len(keys))]
    theirs = one.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_at", F.lit(RIGHT).alias("_side"), row.alias("_row"))
    ours = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(at).alias("_at"), F.lit(LEFT).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_own"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    placed = written(both.repartitionByRange(*names, "_at", "_side").withColumn("_range", F.spark_partition_id()), "asof")

    run = lambda *order: F.last("_row", ignorenulls=True).over(Window.partitionBy("_range", *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    near = placed.withColumn("before", run(F.col("_at").asc(), F.col("_side").asc())).withColumn("after", run(F.col("_at").desc(), F.col("_side").desc()))

    ends = placed.groupBy("_range", *names).agg(F.max("_row").alias("_last"), F.min("_row").alias("_first"))  # the instant leads in _row
    along = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("_from", along("_last", F.col("_range").asc())).withColumn("_to", along("_first", F.col("_range").desc()))
    carried = carried.select(F.col("_range").alias("_r"), *[F.col(n).alias(f"_c{n}") for n in names], "_from", "_to")

    same = [F.col("_range") == F.col("_r"), *[F.col(n).eqNullSafe(F.col(f"_c{n}")) for n in names]]
    found = near.where(F.col("_side") == LEFT).join(carried, same)
    dated = lambda c: F.when(F.col("_at").isNotNull(), c)
    return found.select(*[F.col(f"_own.{c}").alias(c) for c in left.columns], dated(F.coalesce("before", "_from")).alias("before"), dated(F.coalesce("after", "_to")).alias("after"))


def chosen(at: Column, direction: str, tolerance: float | None = None) -> Column:
    """Of ``before`` and ``after``: the one at or before, at or after, or nearest (the earlier on ties), within ``tolerance`` seconds."""
    gap = lambda side: F.abs(F.unix_micros(F.col(f"{side}.at")) - F.unix_micros(at))
    before, after = F.col("before"), F.col("after")
    if direction == "backward":
        found = before
    elif direction == "forward":
        found = F.when(gap("before") == 0, before).otherwise(after)
    elif direction == "nearest":
        found = F.when(after.isNull() | (gap("before") <= gap("after")), before).otherwise(after)
    else:
        raise ValueError(f"no direction {direction}")
    if tolerance is None:
        return found
    return F.when(F.abs(F.unix_micros(found.getField("at")) - F.unix_micros(at)) <= round(tolerance * 1_000_000), found)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, fields: list[str], direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """``left`` with the ``fields`` of its match in ``right`` and the match's instant as ``matched_at``; nulls where there is none."""
    found = neighbours(left, right, keys, at, right_at, fields).withColumn("_match", chosen(F.col(at), direction, tolerance))
    return found.select(*[c for c in left.columns if c not in (*fields, "matched_at")], F.col("_match.at").alias("matched_at"), *[F.col(f"_match.{c}").alias(c) for c in fields])
