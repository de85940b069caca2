"""Chart payloads: JSON with parallel arrays of timestamps and closes, one payload per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD = """chart struct<result: array<struct<
  meta: struct<regularMarketPrice: double, previousClose: double, chartPreviousClose: double>,
  timestamp: array<bigint>, indicators: struct<quote: array<struct<close: array<double>>>>>>>"""


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with the first chart result as ``result``; null where the text isn't such a payload."""
    return payloads.withColumn("result", F.get(F.from_json(column, f"struct<{PAYLOAD}>").chart.result, F.lit(0)))


def chart_rows(payloads: DataFrame, *keys: str) -> DataFrame:
    """(keys (``symbol`` if none are named), ``order``, ``at``, ``date``, ``close``): pairs of the shorter array; rows without a close or time are dropped."""
    keys, result = keys or ("symbol",), parsed(payloads)
    close = F.get(F.col("result.indicators.quote"), F.lit(0)).close
    size = F.least(F.size("result.timestamp"), F.size(close))
    pairs = F.slice(F.arrays_zip(F.col("result.timestamp").alias("t"), close.alias("c")), 1, F.greatest(size, F.lit(0)))
    rows = result.where(F.size(close) > 0).select(*keys, F.posexplode(pairs).alias("order", "pair"))
    rows = rows.select(*keys, "order", F.timestamp_seconds(F.col("pair.t")).alias("at"), F.col("pair.c").alias("close"))
    return rows.where(F.col("close").isNotNull() & F.col("at").isNotNull()).select(*keys, "order", "at", F.to_date("at").alias("date"), "close")


def packed_charts(events: DataFrame, slot: int = 1000) -> DataFrame:
    """Chart payloads from an event table, one for each symbol, day and ``slot`` of that many event ids, so no payload outgrows a value."""
    day = events.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), F.floor(F.col("event_id") / slot).alias("slot"))
    rows = day.agg(F.array_sort(F.collect_list(F.struct("event_id", F.unix_timestamp("ts").alias("t"), "value"))).alias("r"))
    quote = F.struct(F.array(F.struct(F.col("r.value").alias("close"))).alias("quote"))
    result = F.struct(F.col("r.t").alias("timestamp"), quote.alias("indicators"))
    return rows.select("symbol", "slot", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))
