"""Quotes: changes from text prices, fallbacks and source priority, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnframe.functions.exprs import first_nonzero, number, percent_change
from dawnframe.operators.topk import first_k


def quote_change(quotes: DataFrame, price: Column, previous: Column) -> DataFrame:
    """``quotes`` with ``change`` and ``change_pct``; both null if a price doesn't parse or the previous one is zero.

    Thousands commas are accepted, so the same operator serves both quote formats.
    """
    now, before = number(price), number(previous)
    pct = percent_change(now, before)
    return quotes.withColumns({"change": F.when(pct.isNotNull(), now - before), "change_pct": pct})


def change_text(change: Column, pct: Column) -> Column:
    """``+1.20 (+0.85%)``; empty without a change."""
    sign = F.when(change >= 0, "+").otherwise("")
    return F.when(pct.isNull(), "").otherwise(F.concat(sign, F.format_string("%.2f", change), F.lit(" ("), sign, F.format_string("%.2f", pct), F.lit("%)")))


def quote_from_closes(rows: DataFrame, key: str, closes: Column, market: Column, previous: Column, chart_previous: Column) -> DataFrame:
    """``price``, ``prev_close``, ``pct_change`` from the last two known closes, else from the payload's own fields.

    A zero or missing price gives no row.
    """
    known = F.filter(closes, lambda c: c.isNotNull())
    enough = F.size(known) >= 2
    now = F.when(enough, F.try_element_at(known, F.lit(-1))).otherwise(first_nonzero(market, F.try_element_at(known, F.lit(-1))))
    before = F.when(enough, F.try_element_at(known, F.lit(-2))).otherwise(first_nonzero(previous, chart_previous))
    found = rows.select(key, F.nullif(now, F.lit(0.0)).alias("now"), F.nullif(before, F.lit(0.0)).alias("before")).where("now is not null and before is not null")
    return found.select(key, F.round("now", 2).alias("price"), F.round("before", 2).alias("prev_close"), F.round(percent_change(F.col("now"), F.col("before")), 2).alias("pct_change"))


def newest_closes(rows: DataFrame, keys: list[str], order: list[str], close: str, k: int = 2) -> DataFrame:
    """``keys`` and ``closes``: the newest ``k`` known closes of each key, oldest first, for closes that come as rows.

    Only those are shuffled, so a key may hold any share of all rows; a key without a known close has no row.
    """
    newest = first_k(rows.where(F.col(close).isNotNull()).select(*keys, *order, F.col(close).alias("_close")), keys, [F.col(c).desc() for c in order], k, "_nth")
    return newest.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(F.struct("_nth", "_close")))["_close"]).alias("closes"))


def quote_with_fallback(primary: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of either source with the first known value and the source it came from."""
    p = primary.select(key, F.col(value).alias("_p"))
    s = secondary.select(key, F.col(value).alias("_s"))
    source = F.when(F.col("_p").isNotNull(), "primary").when(F.col("_s").isNotNull(), "secondary")
    return p.join(s, key, "full_outer").select(key, F.coalesce("_p", "_s").alias(value), source.alias("source"))


def index_or_nodata(index: Column, places: Column) -> Column:
    """The index; -1 if it is null, or if it is zero and no place has a value (no places at all count as that)."""
    silent = F.coalesce(F.forall(places, lambda p: p.isNull()), F.lit(True))
    return F.when(index.isNull() | ((index == 0) & silent), -1.0).otherwise(index)


def market_filter(quotes: DataFrame, market: Column, wanted: str) -> DataFrame:
    """One market, or every row for ``all``."""
    return quotes if wanted == "all" else quotes.where(F.lower(market) == wanted.lower())


def parse_ticker_list(text: Column, default: list[str]) -> Column:
    """Upper-case tickers of a text, without its ``key:`` prefix; the default list if there are none.

    The prefix is what stands before the first colon that white space follows, so a key may hold colons itself.
    """
    body = F.regexp_replace(text, r"^\s*\S+:(\s+|$)", "")
    found = F.transform(F.filter(F.split(body, r"\s+"), lambda t: t != ""), F.upper)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(d) for d in default]))
