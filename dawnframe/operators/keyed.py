"""Keyed tables: upserts, patches, deletes and guarded changes that answer for all keys at once.

A change set is usually far smaller than its table.  Upserts keep the untouched part by an anti-join on the key (a
broadcast when the change set is small) and append the new rows, so the table isn't sorted.  Operators that can refuse
a change return the accepted rows and the refused ones.

A key may be in a change set several times.  ``order`` then names the columns that tell which change came before which (all
columns, where it isn't given; changes that agree in every column are one change), and each operator says which of them counts: keys of a
table stay unique.  What counts is found by a partial aggregate, so a key with any share of all changes sends few rows.
Null is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnframe.operators.topk import first_k


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on null-safe keys that keeps the left side's."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    found = left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], how)
    return found.drop(*[f"_key_{k}" for k in keys])


def _place(changes: DataFrame, order: list[str] | None) -> Column:
    """A change's place among those of its key: greater is later."""
    return F.struct(*(order or changes.columns))


def last_of_each(changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The last change of each key."""
    fields = [c for c in changes.columns if c not in keys]
    found = changes.groupBy(*keys).agg(F.max(F.struct(_place(changes, order).alias("_place"), *fields)).alias("_last"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in changes.columns])


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """``base`` with the rows of ``batch``; the batch wins, and within it the first by ``order`` (columns such as ``F.col("seq").desc()``)."""
    last = first_k(batch, keys, order) if order else last_of_each(batch, keys)
    last = last.select(*base.columns)
    return _matched(base, last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_entity(base: DataFrame, batch: DataFrame, key: str, now: Column, cleared: tuple[str, ...] = (), order: list[str] | None = None) -> DataFrame:
    """Insert or replace by the last change of each key; ``created_at`` stays that of the first insert, ``updated_at`` becomes ``now``.

    ``cleared`` columns become null on every row that the batch touches.
    """
    last = last_of_each(batch, [key], order)
    old = base.select(F.col(key), F.col("created_at").alias("_created"))
    fields = [c for c in base.columns if c not in (key, "created_at", "updated_at", *cleared)]
    new = _matched(last, old, [key], "left").select(
        key, *fields, *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in cleared],
        F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"),
    )
    return _matched(base, last.select(key), [key], "left_anti").unionByName(new)


def lookup(keys: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Every asked key, its row if there is one, and whether it was ``found``."""
    return keys.join(base.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete_cascade(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given keys."""
    dropped = gone.select(key)
    return parent.join(dropped, key, "left_anti"), child.join(dropped.withColumnRenamed(key, child_key), child_key, "left_anti")


def partial_update(base: DataFrame, patch: DataFrame, key: str, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``base`` with the set (non-null) fields of ``patch``, the last that is set of each field; and the patches of unknown keys."""
    fields = [c for c in patch.columns if c != key and c not in (order or ())]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(_place(patch, order).alias("_place"), F.col(c).alias("_value")))).alias(f"_new_{c}") for c in fields]
    merged = _matched(base, patch.groupBy(key).agg(*last), [key], "left")
    merged = merged.select(*[F.coalesce(F.col(f"_new_{c}._value"), F.col(c)).alias(c) if c in fields else c for c in base.columns])
    return merged, _matched(patch, base.select(key), [key], "left_anti")


def create(base: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with new keys, the first of each key by ``order`` (which tells all rows apart); and those refused as duplicates."""
    place = F.struct(*order)
    first = _matched(rows, base.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.min(place).alias("_first"))
    found = _matched(rows, first, keys, "left").withColumn("_new", F.coalesce(place == F.col("_first"), F.lit(False)))
    return found.where("_new").select(*rows.columns), found.where("not _new").select(*rows.columns)


def update_by_id(base: DataFrame, updates: DataFrame, key: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """The named columns replaced where the id matches, null included; the last update of each id counts."""
    last = last_of_each(updates, [key], order)
    new = last.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = _matched(base, new, [key], "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in base.columns])


#: Rows that a task of ``has_parent`` joins; its sort and hash tables take some hundred bytes a row.
ROWS_A_TASK = 250_000


def has_parent(rows: DataFrame, parent: DataFrame, key: str, parent_key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether their parent exists.

    Both sides are dealt by the key to as many tasks as their rows ask for, so that a task's memory doesn't grow with the tables (Spark merges shuffle
    partitions by their compressed bytes, which say little of it).  The rows are counted for that: hand it tables or narrow views.  What
    is grouped by the key afterwards isn't shuffled again.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, max(rows.count(), parent.count()) // ROWS_A_TASK + 1)
    known = parent.select(F.col(parent_key).alias(key)).repartition(parts, key).distinct().withColumn(flag, F.lit(True))
    return rows.repartition(parts, key).join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_parent(rows: DataFrame, parent: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists, and the others; ``has_parent`` tells both apart in one pass."""
    found = has_parent(rows, parent, key, parent_key, "_known").select(*rows.columns, "_known")
    return found.where("_known").drop("_known"), found.where("not _known").drop("_known")


def transition(rows: DataFrame, requests: DataFrame, key: str, allowed_from: str, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Move rows in state ``allowed_from`` to the requested ``new_status`` (with ``history_id``); and refused requests.

    A row moves by its first request.  A request is refused if the row is unknown, in another state, or has moved by then.
    ``requests.fold`` is for machines in which a row can move more than once.
    """
    place = _place(requests, order)
    asked = requests.where(F.col("new_status").isNotNull())
    first = asked.groupBy(key).agg(F.min(F.struct(place.alias("_place"), F.col("new_status"), F.col("history_id"))).alias("_first"))
    moves = (F.col("status") == allowed_from) & F.col("_first").isNotNull()
    out = _matched(rows, first, [key], "left").select(*[
        F.when(moves, F.col("_first.new_status")).otherwise(F.col("status")).alias("status") if c == "status"
        else F.when(moves, F.col("_first.history_id")).otherwise(F.col("history_id")).alias("history_id") if c == "history_id" else F.col(c)
        for c in rows.columns
    ])
    open_rows = rows.where(F.col("status") == allowed_from).select(key)
    granted = _matched(first, open_rows, [key], "left_semi").select(key, F.col("_first._place").alias("_granted"))
    refused = _matched(requests, granted, [key], "left").where(F.col("new_status").isNull() | ~F.coalesce(place == F.col("_granted"), F.lit(False)))
    return out, refused.select(*requests.columns)


def guarded_write(base: DataFrame, writes: DataFrame, key: str, version: str, columns: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes whose ``version`` is still the row's are applied; the others are returned as skipped.

    Of several such writes the first is applied; the others saw a version that is gone by then.
    """
    place = _place(writes, order)
    now = base.select(key, F.col(version).alias("_now"))
    seen = _matched(writes, now, [key], "inner").where(F.col(version) == F.col("_now"))
    first = seen.groupBy(key).agg(F.min(F.struct(place.alias("_place"), *columns)).alias("_first"))
    joined = _matched(base, first, [key], "left")
    applied = joined.select(*[F.when(F.col("_first").isNotNull(), F.col(f"_first.{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in base.columns])
    granted = first.select(key, F.col("_first._place").alias("_granted"))
    skipped = _matched(writes, granted, [key], "left").where(~F.coalesce(place.eqNullSafe(F.col("_granted")) & F.col("_granted").isNotNull(), F.lit(False)))
    return applied, skipped.select(*writes.columns)


def audit(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """create / update / delete for each changed key, with the changed fields as JSON."""
    b = before.select(F.col(key), F.lit(True).alias("_b"), *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields])
    a = after.select(F.col(key), F.lit(True).alias("_a"), *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields])
    both = b.join(a, key, "full_outer")
    changed = F.create_map(*[x for f in fields for x in (F.lit(f), F.when(~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}")), F.coalesce(f"_a_{f}", F.lit(""))))])
    diff = F.map_filter(changed, lambda _, v: v.isNotNull())
    action = F.when(F.col("_b").isNull(), "create").when(F.col("_a").isNull(), "delete").otherwise("update")
    rows = both.select(key, action.alias("action"), diff.alias("_diff"))
    return rows.where((F.col("action") != "update") | (F.size("_diff") > 0)).select(key, "action", F.to_json("_diff").alias("diff_json"))


BUCKETS = 256


def store_bucketed(rows: DataFrame, path: str, key: str, fields: list[str], buckets: int = BUCKETS) -> None:
    """A version of a table as Parquet, a folder for each bucket of keys, with a digest of each bucket beside it.

    A digest is the number of rows and two hashes of 64 bits of each row, combined without regard to order: a partial aggregate.
    """
    spread = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows.select(key, *fields).withColumn("bucket", spread).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    said = [x for c in (key, *fields) for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    digest = [F.count("*").alias("n"), F.bit_xor(F.xxhash64(*said)).alias("h1"), F.bit_xor(F.xxhash64(F.lit("again"), *said)).alias("h2")]
    rows.groupBy(spread.alias("bucket")).agg(*digest).write.parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, before: str, after: str) -> list[int]:
    """Buckets whose digests differ between two stored versions (of as many buckets each)."""
    b, a = (spark.read.parquet(f"{p}/digests") for p in (before, after))
    same = b.join(a, ["bucket", "n", "h1", "h2"], "left_semi")
    return sorted(r.bucket for r in b.select("bucket").union(a.select("bucket")).distinct().join(same, "bucket", "left_anti").collect())  # at most all buckets


def audit_stored(spark: SparkSession, before: str, after: str, key: str, fields: list[str]) -> DataFrame:
    """``audit`` of two stored versions: buckets with equal digests aren't read."""
    changed = changed_buckets(spark, before, after)
    b, a = (spark.read.parquet(f"{p}/rows").where(F.col("bucket").isin(changed)) for p in (before, after))
    return audit(b, a, key, fields)
