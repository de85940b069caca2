"""Queries of the daily price series: a symbol is an order priority, a close the price of the day's last order."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnframe.functions.exprs import rounded
from dawnframe.operators import series
from dawnframe.plans.registry import query
from dawnframe.sources import charts
from dawnframe.tables import table

LEAD = "1-URGENT"
CLOSES = "c AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2)"
LAST = "w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS newest FROM c)"
CHANGE = "g AS (SELECT symbol, (max(close) FILTER (newest = 1) - max(close) FILTER (newest = 2)) / max(close) FILTER (newest = 2) * 100 AS chg FROM w WHERE newest <= 2 GROUP BY symbol)"
MARK = "CASE WHEN g.chg IS NULL OR l.chg IS NULL THEN 'n/a' WHEN g.chg = 0 OR l.chg = 0 THEN 'flat' WHEN sign(g.chg) = sign(l.chg) THEN 'agree' ELSE 'disagree' END"


def closes(spark, sf_dir, where=None):
    orders = table(spark, sf_dir, "orders")
    return series.daily_close(orders.where(where) if where is not None else orders, "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


@query(
    "t1_upsert_series",
    """WITH e AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey % 2 AS b, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2, 3)
    SELECT symbol, date, arg_max(close, b) AS close FROM e GROUP BY 1, 2""", dates=('date',))
def t1(spark, sf_dir):
    return series.upsert_series(closes(spark, sf_dir, F.col("o_orderkey") % 2 == 0), closes(spark, sf_dir, F.col("o_orderkey") % 2 == 1))


@query("t2_needs_backfill", "SELECT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def t2(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == LEAD).select(F.col("o_custkey").alias("symbol"))
    return series.needs_backfill(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol")), stored)


@query(
    "t3_window_last_n",
    f"WITH {CLOSES}, {LAST}, k AS (SELECT * FROM w WHERE newest <= 252) SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS position FROM k", dates=('date',))
def t3(spark, sf_dir):
    return series.window_last_n(closes(spark, sf_dir))


@query("t4_latest_row", f"WITH {CLOSES} SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM c GROUP BY symbol", dates=('date',))
def t4(spark, sf_dir):
    return series.latest_row(closes(spark, sf_dir))


EVENT_DAYS = "e AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"


@query(
    "a1_chart_rows",
    """SELECT event_type AS symbol, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE), event_id // 1000 ORDER BY event_id) - 1 AS "order", CAST(floor(epoch(ts)) AS BIGINT) AS at, value AS close FROM events QUALIFY value IS NOT NULL""",
    dates=("date",),
)
def a1(spark, sf_dir):
    rows = charts.chart_rows(charts.packed_charts(table(spark, sf_dir, "events")))
    return rows.select("symbol", "date", F.col("order").cast("long").alias("order"), F.unix_seconds("at").alias("at"), "close")


@query("t5_fetch_latest", f"WITH {EVENT_DAYS} SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM e GROUP BY symbol", dates=('date',))
def t5(spark, sf_dir):
    days = charts.chart_rows(charts.packed_charts(table(spark, sf_dir, "events")), "symbol", "slot").withColumn("seq", F.struct("slot", "order"))
    return series.latest_row(series.daily_close(days, "symbol", "at", "close", "seq"))


@query("t6_change_pct", f"WITH {CLOSES}, {LAST}, {CHANGE} SELECT symbol, round(chg, 6) AS change_pct FROM g")
def t6(spark, sf_dir):
    return series.change_pct(closes(spark, sf_dir)).withColumn("change_pct", rounded(F.col("change_pct")))


EXTREMES = """k AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM w WHERE newest <= 252),
x AS (SELECT symbol, any_value(n) AS n_rows, arg_max(date, pos) AS current_day, arg_max(close, pos) AS current_close,
  arg_max(close, pos) FILTER (pos < n - 1) AS prev,
  max({'c': close, 'p': -pos, 'd': date}) AS hi, min({'c': close, 'p': pos, 'd': date}) AS lo FROM k GROUP BY symbol)"""
METRICS = """SELECT symbol, n_rows, current_day, current_close, round((current_close - prev) / prev * 100, 6) AS change_pct,
  hi.d AS high_day, hi.c AS high_close, n_rows - 1 + hi.p AS rows_since_high, round((current_close - hi.c) / hi.c * 100, 6) AS from_high_pct,
  lo.d AS low_day, lo.c AS low_close, n_rows - 1 - lo.p AS rows_since_low, round((current_close - lo.c) / lo.c * 100, 6) AS off_low_pct"""


def _even(found):
    return found.withColumns({c: rounded(F.col(c)) for c in ("change_pct", "from_high_pct", "off_low_pct")})


@query("t7_extremes", f"WITH {CLOSES}, {LAST}, {EXTREMES} {METRICS} FROM x", dates=('current_day', 'high_day', 'low_day'))
def t7(spark, sf_dir):
    return _even(series.metrics(series.window_last_n(closes(spark, sf_dir))))


@query(
    "t8_confirmation",
    f"WITH {CLOSES}, {LAST}, {CHANGE} SELECT g.symbol, round(g.chg, 6) AS change_pct, round(l.chg, 6) AS lead_change, {MARK} AS mark FROM g, (SELECT chg FROM g WHERE symbol = '{LEAD}') l WHERE g.symbol <> '{LEAD}'",
)
def t8(spark, sf_dir):
    found = series.confirmation(series.change_pct(closes(spark, sf_dir)), LEAD)
    return found.withColumns({c: rounded(F.col(c)) for c in ("change_pct", "lead_change")})


@query(
    "t9_regime_snapshot",
    f"WITH {CLOSES}, {LAST}, {CHANGE}, {EXTREMES}, m AS ({METRICS} FROM x) SELECT m.*, CASE WHEN m.symbol = '{LEAD}' THEN 'lead' ELSE {MARK} END AS mark FROM m JOIN g USING (symbol), (SELECT chg FROM g WHERE symbol = '{LEAD}') l", dates=('current_day', 'high_day', 'low_day'))
def t9(spark, sf_dir):
    return _even(series.regime_snapshot(closes(spark, sf_dir), LEAD))


@query(
    "t10_min_history_gate",
    "SELECT user_id AS symbol, count(DISTINCT CAST(ts AS DATE)) AS n_rows, CASE WHEN count(DISTINCT CAST(ts AS DATE)) >= 26 THEN 'ok' WHEN user_id = 1 THEN 'error' ELSE 'n/a' END AS status FROM events GROUP BY user_id",
)
def t10(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date")).distinct()
    return series.min_history_gate(days, 1, 26)


SPLIT = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"
STALE = f"st AS (SELECT symbol, max(date) AS last_day, max(date) < {SPLIT} AS stale FROM c GROUP BY symbol)"


def _stale(spark, sf_dir):
    days = closes(spark, sf_dir)
    newest = days.agg(F.max("date")).scalar()
    return days, series.stale_flag(days, days.where(F.col("date") == newest))


@query("t11_stale_flag", f"WITH {CLOSES}, {STALE} SELECT symbol, last_day, stale FROM st", dates=('last_day',))
def t11(spark, sf_dir):
    return _stale(spark, sf_dir)[1]


def _gated(spark, sf_dir):
    days, stale = _stale(spark, sf_dir)
    return series.latest_row(days).join(stale.select("symbol", "stale"), "symbol")


@query(
    "t12_record_gate",
    f"WITH {CLOSES}, {STALE}, s AS (SELECT symbol, max(date) AS date, arg_max(close, date) AS close, any_value(stale) AS stale FROM c JOIN st USING (symbol) GROUP BY symbol) SELECT * FROM s WHERE (SELECT bool_and(NOT stale) FROM s WHERE symbol IN (SELECT symbol FROM s WHERE NOT stale))", dates=('date',))
def t12(spark, sf_dir):
    found = _gated(spark, sf_dir)
    return series.record_gate(found, found.where(~F.col("stale")).select("symbol"))


@query("t13_snapshot_status", f"WITH {CLOSES}, {STALE} SELECT symbol, CASE WHEN stale THEN 'no close on the last day' END AS warning, CASE WHEN stale THEN 'degraded' ELSE 'ok' END AS status FROM st")
def t13(spark, sf_dir):
    found = _stale(spark, sf_dir)[1].select("symbol", F.when(F.col("stale"), "no close on the last day").alias("warning"))
    return series.snapshot_status(found)


@query(
    "t14_snapshot_text",
    f"""WITH {CLOSES}, {LAST}, {EXTREMES}, m AS ({METRICS} FROM x)
    SELECT symbol, symbol || ': $' || printf('%.2f', current_close) || ' (' || CASE WHEN change_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', change_pct) || '%)' AS line,
    'high $' || printf('%.2f', high_close) || ', ' || high_day || ', ' || rows_since_high || ' rows ago, ' || CASE WHEN from_high_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', from_high_pct) || '%' AS high_line,
    'low $' || printf('%.2f', low_close) || ', ' || low_day || ', ' || rows_since_low || ' rows ago, ' || CASE WHEN off_low_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', off_low_pct) || '%' AS low_line FROM m""",
)
def t14(spark, sf_dir):
    return series.snapshot_text(_even(series.metrics(series.window_last_n(closes(spark, sf_dir)))))


@query(
    "t14_report_text",
    f"""WITH {CLOSES}, {LAST}, {EXTREMES}, m AS ({METRICS} FROM x), {STALE}, z AS (SELECT m.*, stale, (SELECT change_pct FROM m WHERE symbol = '{LEAD}') AS lead FROM m JOIN st USING (symbol)),
    p AS (SELECT *, CASE WHEN change_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', change_pct) || '%' AS t FROM z),
    seg AS (SELECT string_agg(CASE WHEN change_pct IS NULL THEN symbol || ' n/a' ELSE symbol || ' ' || CASE WHEN change_pct = 0 OR lead = 0 THEN '–' WHEN (change_pct > 0) = (lead > 0) THEN '✓' ELSE '✗' END || ' (' || t || ')' || CASE WHEN stale THEN ' (stale)' ELSE '' END END, '   ' ORDER BY symbol) AS s FROM p WHERE symbol <> '{LEAD}')
    SELECT symbol, 'Prices' || chr(10) || CASE WHEN stale THEN '[WARN: no close on the last day]' || chr(10) ELSE '' END || symbol || ': $' || printf('%.2f', current_close) || ' (' || t || ')' || CASE WHEN stale THEN ' (stale)' ELSE '' END || chr(10) ||
      '  high $' || printf('%.2f', high_close) || ', ' || high_day || ', ' || rows_since_high || ' rows ago, ' || CASE WHEN from_high_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', from_high_pct) || '%' || chr(10) ||
      '  low $' || printf('%.2f', low_close) || ', ' || low_day || ', ' || rows_since_low || ' rows ago, ' || CASE WHEN off_low_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', off_low_pct) || '%' || chr(10) || '確認：' || (SELECT s FROM seg) AS text,
      CASE WHEN stale THEN 'degraded' ELSE 'ok' END AS status FROM p WHERE symbol = '{LEAD}'""",
)
def t14_report(spark, sf_dir):
    found = _even(series.metrics(series.window_last_n(closes(spark, sf_dir)))).join(_stale(spark, sf_dir)[1].select("symbol", "stale"), "symbol")
    found = found.withColumn("warning", F.when(F.col("stale"), "no close on the last day"))
    marks = series.confirmation(found.select("symbol", "change_pct"), LEAD).join(found.select("symbol", "stale"), "symbol")
    return series.report_text(found, marks, LEAD, "Prices")
