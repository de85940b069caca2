"""Daily price series ``(symbol, date, close)``: windows, extremes, changes and confirmation, for all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnframe.functions.exprs import percent_change
from dawnframe.operators.keyed import upsert
from dawnframe.operators.topk import first_k

#: Signs of the confirmation marks in a report.
MARKS = {"agree": "✓", "disagree": "✗", "flat": "–"}
WINDOW_ROWS = 252
LEAST_ROWS = 20


def daily_close(trades: DataFrame, symbol: str, at: str, price: str, order: str) -> DataFrame:
    """The last price of each symbol and day, last by ``order``."""
    return trades.groupBy(F.col(symbol).alias("symbol"), F.to_date(at).alias("date")).agg(F.max_by(price, order).alias("close"))


def upsert_series(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Last write wins on (symbol, date); ``batch`` may carry ``batch_seq`` to order its own rows."""
    order = [F.col("batch_seq").desc()] if "batch_seq" in batch.columns else None
    return upsert(base, batch, ["symbol", "date"], order)


def needs_backfill(symbols: DataFrame, series: DataFrame) -> DataFrame:
    """Symbols without a stored row."""
    return symbols.join(series.select("symbol"), "symbol", "left_anti")


def window_last_n(series: DataFrame, n: int = WINDOW_ROWS) -> DataFrame:
    """The newest ``n`` rows of each symbol with ``position`` from 0, oldest first.  Rows count, not calendar days."""
    kept = first_k(series, ["symbol"], [F.col("date").desc()], n, rank="_newest")
    size = F.count("*").over(Window.partitionBy("symbol"))
    return kept.select("symbol", "date", "close", (size - F.col("_newest")).cast("long").alias("position"))


def latest_row(series: DataFrame) -> DataFrame:
    """The newest row of each symbol; partial maxima before the shuffle."""
    return series.groupBy("symbol").agg(F.max(F.struct("date", "close")).alias("last")).select("symbol", "last.date", "last.close")


def metrics(window: DataFrame) -> DataFrame:
    """Of each windowed symbol: current row, change, and high and low with date, rows since and distance.

    Ties go to the earliest row.  One aggregation: the last two rows and both extremes are maxima and minima of structs.
    """
    spot = F.struct(F.col("close"), (-F.col("position")).alias("back"), F.col("date"))
    low = F.struct(F.col("close"), F.col("position"), F.col("date"))
    recent = F.slice(F.sort_array(F.collect_list(F.when(F.col("_left") < 2, F.struct("position", "date", "close"))), asc=False), 1, 2)
    size = F.count("*").over(Window.partitionBy("symbol"))
    rows = window.withColumn("_left", size - 1 - F.col("position"))
    agg = rows.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.max(spot).alias("high"), F.min(low).alias("low"), recent.alias("recent"))
    now, before = F.get("recent", F.lit(0)), F.get("recent", F.lit(1))
    last = F.col("n_rows") - 1
    return agg.select(
        "symbol", "n_rows",
        now.date.alias("current_day"), now.close.alias("current_close"),
        percent_change(now.close, before.close).alias("change_pct"),
        F.col("high.date").alias("high_day"), F.col("high.close").alias("high_close"), (last + F.col("high.back")).alias("rows_since_high"),
        percent_change(now.close, F.col("high.close")).alias("from_high_pct"),
        F.col("low.date").alias("low_day"), F.col("low.close").alias("low_close"), (last - F.col("low.position")).alias("rows_since_low"),
        percent_change(now.close, F.col("low.close")).alias("off_low_pct"),
    )


def change_pct(series: DataFrame) -> DataFrame:
    """Percent change of the last two rows; null with fewer than two."""
    kept = first_k(series, ["symbol"], [F.col("date").desc()], 2, rank="nth")
    pick = lambda n: F.max(F.when(F.col("nth") == n, F.col("close")))
    return kept.groupBy("symbol").agg(percent_change(pick(1), pick(2)).alias("change_pct"))


def confirmation_mark(change: Column, lead: Column) -> Column:
    """agree / disagree / flat (either is exactly zero) / n/a (no change known)."""
    return F.when(change.isNull() | lead.isNull(), "n/a").when((change == 0) | (lead == 0), "flat").when(F.signum(change) == F.signum(lead), "agree").otherwise("disagree")


def confirmation(changes: DataFrame, lead: str) -> DataFrame:
    """Every other symbol against the lead's change, a scalar subquery."""
    of_lead = changes.where(F.col("symbol") == lead).agg(F.max("change_pct"))
    rest = changes.where(F.col("symbol") != lead).select("symbol", "change_pct", of_lead.scalar().alias("lead_change"))
    return rest.withColumn("mark", confirmation_mark(F.col("change_pct"), F.col("lead_change")))


def regime_snapshot(series: DataFrame, lead: str, n: int = WINDOW_ROWS) -> DataFrame:
    """Window, metrics and confirmation of every symbol in one result; the lead's mark is ``lead``."""
    found = metrics(window_last_n(series, n))
    of_lead = change_pct(series.where(F.col("symbol") == lead)).select("change_pct").scalar()  # a scan of one symbol
    mark = F.when(F.col("symbol") == lead, "lead").otherwise(confirmation_mark(F.col("change_pct"), F.col("_lead")))
    return found.withColumn("_lead", of_lead).select(*found.columns, mark.alias("mark"))


def min_history_gate(series: DataFrame, lead: str | None, least: int = LEAST_ROWS) -> DataFrame:
    """Each symbol's rows and status: ok, or with too few rows error for the lead and n/a for the others."""
    sizes = series.groupBy("symbol").agg(F.count("*").alias("n_rows"))
    short = F.when(F.col("symbol").eqNullSafe(F.lit(lead)), "error").otherwise("n/a")
    return sizes.select("symbol", "n_rows", F.when(F.col("n_rows") >= least, "ok").otherwise(short).alias("status"))


def stale_flag(series: DataFrame, batch: DataFrame) -> DataFrame:
    """Symbols of the series with their newest day, stale if the newest batch lacks them."""
    fresh = batch.select("symbol").distinct().withColumn("_fresh", F.lit(True))
    newest = series.groupBy("symbol").agg(F.max("date").alias("last_day"))
    return newest.join(fresh, "symbol", "left").select("symbol", "last_day", F.col("_fresh").isNull().alias("stale"))


def record_gate(snapshot: DataFrame, required: DataFrame) -> DataFrame:
    """The snapshot if every required symbol is there, has a close and isn't stale; otherwise nothing."""
    state = required.join(snapshot, "symbol", "left").agg(F.bool_and(F.col("close").isNotNull() & ~F.coalesce("stale", F.lit(True))))
    return snapshot.where(F.coalesce(state.scalar(), F.lit(False)))


def snapshot_status(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("status", F.when(F.col("warning").isNotNull(), "degraded").otherwise("ok"))


def price_text(x: Column) -> Column:
    return F.format_string("$%.2f", x)


def percent_text(x: Column) -> Column:
    """One decimal with a sign.  Halves round up here; binary half-even text would differ on exact ties only."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string("%.1f%%", x))


def confirmation_segment(label: Column, change: Column, mark: Column, stale: Column) -> Column:
    """``Brent ✓ (+0.8%)``, with ``(stale)`` behind it where it is; ``Brent n/a`` without a window."""
    sign = F.when(mark == "agree", MARKS["agree"]).when(mark == "disagree", MARKS["disagree"]).otherwise(MARKS["flat"])
    known = F.concat(label, F.lit(" "), sign, F.lit(" ("), percent_text(change), F.lit(")"), F.when(F.coalesce(stale, F.lit(False)), " (stale)").otherwise(""))
    return F.when(change.isNull(), F.concat(label, F.lit(" n/a"))).otherwise(known)


def report_text(found: DataFrame, marks: DataFrame, lead: str, title: str) -> DataFrame:
    """(``text``, ``status``) of the lead's report: title, warning, price, high, low, and the others' confirmation in their order.

    ``found``: the snapshot of every symbol with ``stale`` and ``warning``; ``marks``: (symbol, change_pct, mark, stale) of the others.
    """
    lines = snapshot_text(found.where(F.col("symbol") == lead)).join(found.where(F.col("symbol") == lead).select("symbol", "stale", "warning"), "symbol")
    segments = marks.select("symbol", confirmation_segment(F.col("symbol"), F.col("change_pct"), F.col("mark"), F.col("stale")).alias("segment"))
    joined = segments.agg(F.array_join(F.array_sort(F.collect_list(F.struct("symbol", "segment")))["segment"], "   "))  # one short text for each symbol
    warned = F.when(F.coalesce("warning", F.lit("")) != "", F.concat(F.lit("[WARN: "), F.col("warning"), F.lit("]")))
    price = F.concat(F.col("line"), F.when(F.coalesce("stale", F.lit(False)), " (stale)").otherwise(""))
    text = F.concat_ws("\n", F.lit(title), warned, price, F.concat(F.lit("  "), F.col("high_line")), F.concat(F.lit("  "), F.col("low_line")), F.concat(F.lit("確認："), joined.scalar()))
    return lines.select("symbol", text.alias("text"), F.when(warned.isNotNull(), "degraded").otherwise("ok").alias("status"))


def snapshot_text(found: DataFrame) -> DataFrame:
    """``symbol`` and the lines of its report: price, high and low."""
    return found.select(
        "symbol",
        F.concat(F.col("symbol"), F.lit(": "), price_text(F.col("current_close")), F.lit(" ("), percent_text(F.col("change_pct")), F.lit(")")).alias("line"),
        F.concat_ws(", ", F.concat(F.lit("high "), price_text(F.col("high_close"))), F.col("high_day").cast("string"), F.concat(F.col("rows_since_high").cast("string"), F.lit(" rows ago")), percent_text(F.col("from_high_pct"))).alias("high_line"),
        F.concat_ws(", ", F.concat(F.lit("low "), price_text(F.col("low_close"))), F.col("low_day").cast("string"), F.concat(F.col("rows_since_low").cast("string"), F.lit(" rows ago")), percent_text(F.col("off_low_pct"))).alias("low_line"),
    )
