"""Forecasts and routes: nearest in time, pivots, routing by set, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the text for what is missing.
MISSING = "資料無法取得"


def nearest_in_time(records: DataFrame, key: str, now: Column, element: str = "Wx") -> DataFrame:
    """(key, idx) of the record of ``element`` whose start is nearest to ``now``; the earliest on ties, 0 if none parses.

    Starts are local times at +08:00.  One partial minimum for each key goes through the shuffle.
    """
    local = F.try_to_timestamp(F.col("start"), F.lit("yyyy-MM-dd HH:mm:ss"))
    gap = F.abs(F.unix_timestamp(F.to_utc_timestamp(local, "+08:00")) - F.unix_timestamp(now))
    rows = records.where(F.col("element") == element).select(key, F.when(gap.isNotNull(), F.struct(gap.alias("gap"), F.col("idx"))).alias("_c"))
    return rows.groupBy(key).agg(F.coalesce(F.min("_c").idx, F.lit(0)).alias("idx"))


def pivot_elements(records: DataFrame, chosen: DataFrame, key: str, elements: list[str]) -> DataFrame:
    """One row for each key: the values of the listed elements at its chosen index."""
    at = records.join(chosen, [key, "idx"])
    return at.groupBy(key).pivot("element", elements).agg(F.first("value"))


def route_requests(requests: DataFrame, name: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose trimmed, case-folded name is in the set ``known(name)``, and the others."""
    rows = requests.withColumn("_key", F.lower(F.trim(F.col(name))))
    keys = known.select(F.lower(F.trim("name")).alias("_key")).distinct()
    return rows.join(keys, "_key", "left_semi").drop("_key"), rows.join(keys, "_key", "left_anti").drop("_key")


def join_requested(requests: DataFrame, records: DataFrame, key: str, value: str, marker: str = MISSING) -> DataFrame:
    """Every request with its record's value, or the marker."""
    return requests.join(records.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(marker)))


FORECAST = "array<struct<forecastWeather: string, forecastMintemp: struct<value: int>, forecastMaxtemp: struct<value: int>, PSR: string>>"


def daily_forecast_row(payloads: DataFrame, raw: str, key: str) -> DataFrame:
    """The first forecast of each payload, with ``?`` for missing values and an empty rain chance."""
    first = F.try_element_at(F.from_json(raw, f"struct<weatherForecast: {FORECAST}>").weatherForecast, F.lit(1))
    text = lambda c, d: F.coalesce(c.cast("string"), F.lit(d))
    rows = payloads.select(key, first.alias("f"))
    return rows.select(key, text(F.col("f.forecastWeather"), "?").alias("weather"), text(F.col("f.forecastMintemp.value"), "?").alias("low"), text(F.col("f.forecastMaxtemp.value"), "?").alias("high"), text(F.col("f.PSR"), "").alias("rain"))


def resolve_location(rows: DataFrame, name: str, places: DataFrame) -> DataFrame:
    """``coord`` from the dictionary ``places(name, coord)``, else the name itself if it is ``lat,lon``; null if unknown."""
    pair = F.split(name, ",", -1)
    number = lambda i: F.trim(F.get(pair, F.lit(i))).try_cast("double").isNotNull()
    own = F.when((F.size(pair) == 2) & number(0) & number(1), F.col(name))
    known = places.select(F.col("name").alias(name), F.col("coord").alias("_coord"))
    return rows.join(known, name, "left").withColumn("coord", F.coalesce("_coord", own)).drop("_coord")


def route_build(origin: Column, via: Column, dest: Column, names: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """(label, waypoints) of a route with two or three known points; null otherwise.  A null name of via means none."""
    points = F.array_compact(F.array(origin, via, dest))
    wanted = F.size(F.array_compact(F.array(*names)))
    whole = (F.size(points) == wanted) & wanted.between(2, 3)
    label = F.array_join(F.array_compact(F.array(*names)), "→")
    return F.when(whole, label), F.when(whole, F.array_join(points, ":"))


def travel_minutes(seconds: Column) -> Column:
    """Whole minutes, halves to even."""
    return F.bround(seconds / 60).cast("long")


def travel_band(minutes: Column) -> Column:
    return F.when(minutes < 25, "light").when(minutes <= 40, "usual").otherwise("heavy")
