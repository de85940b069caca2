"""Queries of the forecast and route operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnframe.operators import asof, places
from dawnframe.plans.registry import query
from dawnframe.sources import feeds
from dawnframe.tables import table

NOW = "2024-01-15 00:00:00"
RECORDS = """r AS (SELECT 'u' || user_id || '.' || event_id // 1000 AS location, CASE event_type WHEN 'view' THEN 'Wx' ELSE event_type END AS element, row_number() OVER (PARTITION BY user_id, event_id // 1000, event_type ORDER BY event_id) - 1 AS idx,
  CASE WHEN event_id % 13 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS start, 'v' || event_id AS value FROM events)"""
CHOSEN = f"""c AS (SELECT location, coalesce(arg_min(idx, {{'g': abs(epoch(CAST(date_trunc('second', TRY_CAST(start AS TIMESTAMP)) AS TIMESTAMP)) - 28800 - epoch(TIMESTAMP '{NOW}')), 'i': idx}}) FILTER (start <> 'soon'), 0) AS idx FROM r WHERE element = 'Wx' GROUP BY location)"""


def payloads(spark, sf_dir):
    """A nested forecast payload for each user and thousand event ids: an element for each event type, a time for each event."""
    element = F.when(F.col("event_type") == "view", "Wx").otherwise(F.col("event_type"))
    start = F.when(F.col("event_id") % 13 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    value = F.struct(F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("parameterName"))
    rows = table(spark, sf_dir, "events").select(F.concat_ws(".", F.concat(F.lit("u"), F.col("user_id").cast("string")), F.floor(F.col("event_id") / 1000).cast("string")).alias("place"), element.alias("elementName"), F.struct("event_id", start.alias("startTime"), value.alias("parameter")).alias("t"))
    times = rows.groupBy("place", "elementName").agg(F.array_sort(F.collect_list("t")).alias("time"))
    place = times.groupBy("place").agg(F.collect_list(F.struct("elementName", "time")).alias("weatherElement"))
    location = F.struct(F.col("place").alias("locationName"), "weatherElement")
    return place.select(F.to_json(F.struct(F.struct(F.array(location).alias("location")).alias("records"))).alias("raw"))


@query("a5_forecast_elements", f"WITH {RECORDS} SELECT location, element, idx, start, value FROM r")
def a5(spark, sf_dir):
    return feeds.forecast_elements(payloads(spark, sf_dir), "raw")


def _nearest(spark, sf_dir):
    records = feeds.forecast_elements(payloads(spark, sf_dir), "raw")
    return records, places.nearest_in_time(records, "location", F.lit(NOW).cast("timestamp"))


@query("g1_nearest_in_time", f"WITH {RECORDS}, {CHOSEN} SELECT location, idx FROM c")
def g1(spark, sf_dir):
    return _nearest(spark, sf_dir)[1]


#: Orders moved into the month of the events: an instant of the day for each order.
MOMENT = "TIMESTAMP '2024-01-01' + to_seconds(CAST((epoch(o_orderdate) // 86400) % 30 * 86400 + (o_orderkey * 7919) % 86400 AS BIGINT))"


def orders_in_january(spark, sf_dir, key):
    days = F.floor(F.unix_timestamp("o_orderdate") / 86400) % 30
    moment = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + days * 86400 + (F.col("o_orderkey") * 7919) % 86400)
    return table(spark, sf_dir, "orders").select(key, moment.alias("placed_at"), F.col("o_orderkey").alias("order_id"))


def _events(spark, sf_dir, key):
    return table(spark, sf_dir, "events").select("event_id", key, F.col("ts").cast("timestamp").alias("ts"))


def _asof_sql(event_key: str, order_key: str) -> str:
    """SQL: both neighbours by DuckDB's as-of join; the least order of an instant."""
    return f"""WITH e AS (SELECT event_id, {event_key} AS k, ts FROM events), o AS (SELECT {order_key} AS k, {MOMENT} AS placed_at, min(o_orderkey) AS order_id FROM orders GROUP BY ALL),
    b AS (SELECT event_id, order_id, placed_at FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.ts >= o.placed_at), f AS (SELECT event_id, order_id, placed_at FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.ts <= o.placed_at)
    SELECT event_id, b.order_id AS backward, f.order_id AS forward, CASE WHEN f.placed_at IS NULL OR ts - b.placed_at <= f.placed_at - ts THEN b.order_id ELSE f.order_id END AS nearest,
    CASE WHEN epoch_us(ts) - epoch_us(b.placed_at) <= 3600000000 THEN b.order_id END AS within_hour FROM e JOIN b USING (event_id) JOIN f USING (event_id)"""


def _asof(spark, sf_dir, event_key, order_key):
    rows, orders = _events(spark, sf_dir, event_key.alias("k")), orders_in_january(spark, sf_dir, order_key.alias("k"))
    found = asof.neighbours(rows, orders, ["k"], "ts", "placed_at", ["order_id"])
    pick = lambda *how: asof.chosen(F.col("ts"), *how).getField("order_id")
    return found.select("event_id", pick("backward").alias("backward"), pick("forward").alias("forward"), pick("nearest").alias("nearest"), pick("backward", 3600).alias("within_hour"))


@query("g1_asof_orders", _asof_sql("user_id", "o_custkey"))
def g1_asof(spark, sf_dir):
    """The order of the same customer before, after and nearest to each event."""
    return _asof(spark, sf_dir, F.col("user_id"), F.col("o_custkey"))


@query("g1_asof_hot_key", _asof_sql("CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 + user_id % 40 END", "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 + o_custkey % 40 END"))
def g1_asof_hot(spark, sf_dir):
    """The same by groups of customers, one of which has a third of all rows."""
    group = lambda c: F.when(F.col(c) % 3 == 0, 0).otherwise(1 + F.col(c) % 40)
    return _asof(spark, sf_dir, group("user_id"), group("o_custkey"))


@query(
    "g2_pivot_elements",
    f"""WITH {RECORDS}, {CHOSEN} SELECT location, max(value) FILTER (element = 'Wx') AS "Wx", max(value) FILTER (element = 'click') AS click, max(value) FILTER (element = 'error') AS error, max(value) FILTER (element = 'purchase') AS purchase
    FROM r JOIN c USING (location, idx) GROUP BY location""",
)
def g2(spark, sf_dir):
    records, chosen = _nearest(spark, sf_dir)
    return places.pivot_elements(records, chosen, "location", ["Wx", "click", "error", "purchase"])


@query("g3_route_requests", "SELECT c_custkey, n_name AS name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'inside' ELSE 'outside' END AS route FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def g3(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    asked = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    names = asked.select("c_custkey", F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("name"))
    region = table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    known = nations.join(region, nations.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("name"))
    inside, outside = places.route_requests(names, "name", known)
    both = inside.withColumn("route", F.lit("inside")).unionByName(outside.withColumn("route", F.lit("outside")))
    return both.select("c_custkey", F.upper(F.trim("name")).alias("name"), "route")


@query("g4_join_requested", "SELECT n_nationkey AS nation, coalesce(CAST(n AS VARCHAR), '資料無法取得') AS suppliers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) ON s_nationkey = n_nationkey")
def g4(spark, sf_dir):
    records = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").cast("string").alias("suppliers"))
    return places.join_requested(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")), records, "nation", "suppliers")


@query(
    "g5_daily_forecast_row",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '?' ELSE event_type END AS weather, CAST(user_id AS VARCHAR) AS low, CASE WHEN event_id % 3 = 1 THEN '?' ELSE CAST(user_id + 5 AS VARCHAR) END AS high, CASE WHEN event_id % 3 = 2 THEN '30%' ELSE '' END AS rain FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, '?', '?', '?', '' FROM events WHERE event_id % 7 = 0",
)
def g5(spark, sf_dir):
    kind = F.col("event_id") % 3
    value = lambda x: F.struct(x.alias("value"))
    day = F.struct(
        F.when(kind != 0, F.col("event_type")).alias("forecastWeather"), value(F.col("user_id").cast("int")).alias("forecastMintemp"),
        F.when(kind != 1, value((F.col("user_id") + 5).cast("int"))).alias("forecastMaxtemp"), F.when(kind == 2, "30%").alias("PSR"),
    )
    raw = F.when(F.col("event_id") % 7 == 0, '{"weatherForecast": []}').otherwise(F.to_json(F.struct(F.array(day).alias("weatherForecast"))))
    return places.daily_forecast_row(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "event_id")


@query(
    "g6_resolve_location",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_nationkey || ',' || n_regionkey WHEN 1 THEN ' 25.1, ' || c_custkey ELSE NULL END AS coord FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def g6(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    kind = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lit(" 25.1, "), F.col("c_custkey").cast("string"))).when(kind == 2, "25.1,x").otherwise("nowhere")
    known = nations.select(F.col("n_name").alias("name"), F.concat_ws(",", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("coord"))
    return places.resolve_location(rows.select("c_custkey", name.alias("place")), "place", known).select("c_custkey", "coord")


@query(
    "g7_route_build",
    """WITH o AS (SELECT o_orderkey, c_nationkey, n_name, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Home→' || n_name ELSE 'Home→Via→' || n_name END AS label,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN '1,1:' || c_nationkey || ',2' ELSE '1,1:3,3:' || c_nationkey || ',2' END AS waypoints FROM o""",
)
def g7(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    has_via = F.col("o_orderkey") % 2 == 1
    dest = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.col("c_nationkey").cast("string"), F.lit(",2")))
    label, points = places.route_build(F.lit("1,1"), F.when(has_via, "3,3"), dest, (F.lit("Home"), F.when(has_via, "Via"), F.col("n_name")))
    return rows.select("o_orderkey", label.alias("label"), points.alias("waypoints"))


@query("g8_travel_minutes", "SELECT event_id, CAST(round_even(floor(value * 30) * 30 / 60.0, 0) AS BIGINT) AS minutes FROM events")
def g8(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", places.travel_minutes(F.floor(F.col("value") * 30) * 30).alias("minutes"))


@query("g9_travel_band", "SELECT event_id, CASE WHEN value * 3 < 25 THEN 'light' WHEN value * 3 <= 40 THEN 'usual' ELSE 'heavy' END AS band FROM events")
def g9(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", places.travel_band(F.col("value") * 3).alias("band"))
