"""Structured Streaming forms of the polling jobs.

Streams that change a table write change parts (``changes``); the others keep their state in Spark and append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dawnframe.operators.topk import first_k
from dawnframe.streaming import changes


def _newest(keys: tuple[str, ...], order: str) -> changes.Merge:
    return lambda rows: first_k(rows, list(keys), [F.col(order).desc()])


def stream_upsert_series(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "date"), order: str = "seq", ratio: float = changes.RATIO) -> StreamingQuery:
    """Every micro-batch is a poll that is merged into the table: the row with the largest ``order`` wins on the keys.

    ``order`` tells which write is the last, so polls may arrive in any order and twice.  A poll writes its own rows;
    ``ratio`` says when the table is compacted.  Read the result with ``read_series``.
    """
    write = lambda batch, batch_id: changes.change(batch, path, batch_id, _newest(keys, order), ratio)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_series(spark: SparkSession, path: str, schema, keys: tuple[str, ...] = ("symbol", "date"), order: str = "seq") -> DataFrame:
    """What ``stream_upsert_series`` wrote."""
    return changes.read(spark, path, schema, _newest(keys, order))


def _last(keys: list[str], at: str, fields: list[str]) -> changes.Merge:
    def merge(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.max(F.struct(at, *fields)).alias("_last"), F.min("first_at").alias("first_at"))
        return found.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (at, *fields)], "first_at")

    return merge


def stream_latest_status(stream: DataFrame, path: str, checkpoint: str, keys: list[str], at: str, started: str, fields: list[str], ratio: float = changes.RATIO) -> StreamingQuery:
    """Every micro-batch adds the last heartbeat of each of its keys; beats may arrive in any order.  Read with ``read_latest_status``.

    Keys that send nothing cost nothing: there is no state to go through, and a poll writes a row for each of its own keys.
    """
    rows = stream.select(*keys, at, *fields, F.col(started).alias("first_at"))
    write = lambda batch, batch_id: changes.change(batch, path, batch_id, _last(keys, at, fields), ratio)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest_status(spark: SparkSession, path: str, schema, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    """Keys, last heartbeat with its fields, and the seconds since the first start; ``schema``: keys, at, fields, first_at."""
    found = changes.read(spark, path, schema, _last(keys, at, fields))
    elapsed = (F.unix_micros(at) - F.unix_micros("first_at")) / 1e6
    return found.select(*keys, at, *fields, elapsed.alias("elapsed_sec"))


def stream_dedup_items(stream: DataFrame, keys: list[str], at: str, horizon: str = "24 hours") -> DataFrame:
    """The first processed row of each key within the horizon.

    A key is forgotten once the watermark passes its row's instant plus the horizon, and its next row comes back; rows at or before
    the watermark are late and dropped.  The state holds the keys of about two horizons.
    """
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def stream_status_rollup(stream: DataFrame, job: str, at: str, status: str, late: str = "1 day") -> DataFrame:
    """Counts by job, day and status in daily windows.  In append mode a day comes out once the watermark has passed it, and its state goes.

    Rows of a day that has come out are late and don't count; ``late_rows`` tells how many.
    """
    return stream.withWatermark(at, late).groupBy(job, F.window(at, "1 day"), status).agg(F.count("*").alias("n"))


def late_rows(arrived: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """What closed windows counted (``n``) and how many of their rows came too late (``late``); ``arrived`` has every row's count (``read_tally``)."""
    every = arrived.withColumnRenamed("n", "_all")
    closed = counted.select("window").distinct()
    found = every.join(closed, "window", "left_semi").join(counted, keys, "left")
    return found.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), (F.col("_all") - F.coalesce("n", F.lit(0))).alias("late"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))


def tally(stream: DataFrame, path: str, checkpoint: str, keys: list, ratio: float = changes.RATIO) -> StreamingQuery:
    """Counts by ``keys`` of everything that arrives, late or not.  Read with ``read_tally``.

    Each batch writes its own counts; a base holds every batch up to its own once, so sums don't change when a batch runs again.
    """
    ones = stream.select(*keys, F.lit(1).cast("long").alias("n"))
    write = lambda batch, batch_id: changes.change(batch, path, batch_id, _summed, ratio)
    return ones.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_tally(spark: SparkSession, path: str, schema) -> DataFrame:
    """``schema``: the keys and n."""
    return changes.read(spark, path, schema, _summed)


def drained(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything there is and write it as Parquet."""
    result.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
