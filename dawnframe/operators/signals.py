"""Model signals: consensus of two models, ranking, sections, rollups and tolerant parsing of model output."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnframe.functions.exprs import first_filled
from dawnframe.operators.topk import first_k, numbered

HIGH_CONFIDENCE = 0.70
#: Headers of a report's sections: agreed, diverged, one model only.
SECTION_HEADERS = ["🎯 共識訊號", "⚠️ 分歧訊號", "📊 單一參考"]
#: Lines of a daily summary that say nothing.
BOILERPLATE = ["Market closed", "Daily analysis complete", "Tomorrow's outlook prepared"]


def merge_models(tickers: DataFrame, primary: DataFrame, backup: DataFrame, key: str = "ticker") -> DataFrame:
    """One row for each ticker that a model answered: sentiment, confidence, reason, ``diverged``, ``n_models``.

    Both agree: mean confidence.  They disagree: the primary wins and the row is marked.  One only: that one.
    ``primary_*`` and ``backup_*`` keep what each model said; null where it said nothing.
    """
    p = primary.select(key, F.lower("sentiment").alias("p_sent"), F.col("confidence").alias("p_conf"), F.col("reason").alias("p_reason"))
    b = backup.select(key, F.lower("sentiment").alias("b_sent"), F.col("confidence").alias("b_conf"), F.col("reason").alias("b_reason"))
    rows = tickers.join(p, key, "left").join(b, key, "left")
    has_p, has_b = (F.coalesce(F.col(c) != "", F.lit(False)) for c in ("p_sent", "b_sent"))
    conf_p, conf_b = (F.coalesce(c, F.lit(0.0)) for c in ("p_conf", "b_conf"))
    agree = has_p & has_b & (F.col("p_sent") == F.col("b_sent"))
    return rows.where(has_p | has_b).select(
        *tickers.columns,
        F.when(has_p, F.col("p_sent")).otherwise(F.col("b_sent")).alias("sentiment"),
        F.when(agree, (conf_p + conf_b) / 2).when(has_p, conf_p).otherwise(conf_b).alias("confidence"),
        F.coalesce(first_filled(F.col("p_reason"), F.col("b_reason")), F.lit("")).alias("reason"),
        (has_p & has_b & ~agree).alias("diverged"),
        (has_p.cast("int") + has_b.cast("int")).alias("n_models"),
        *[F.when(has, F.col(f"{m}_{short}")).alias(f"{name}_{long}") for m, name, has in (("p", "primary", has_p), ("b", "backup", has_b)) for short, long in (("sent", "sentiment"), ("conf", "confidence"), ("reason", "reason"))],
    )


def rank_signals(rows: DataFrame, report: str, position: str) -> DataFrame:
    """``rank`` within each report: diverged first, then by confidence, then in the given order."""
    return numbered(rows, [report], [F.col("diverged").desc(), F.col("confidence").desc(), F.col(position)])


def signal_section(rows: DataFrame) -> DataFrame:
    """``section`` as reports print it: a single model's answer stands under consensus; ``n_models`` tells them apart."""
    return rows.withColumn("section", F.when(F.col("diverged"), "diverged").otherwise("consensus"))


def report_text(rows: DataFrame, report: str, ticker: str, position: str, label: dict[str, str]) -> DataFrame:
    """(report, ``text``): the lines of each report's merged signals, by section and then in the given order.

    Sections: agreed by two models, diverged (both answers, reasons cut at 70), one model only (reasons cut at 80); each has its
    header, and a blank line before it unless it is the first.  A report is one text, so it holds the signals of one report only.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    percent = lambda c: F.concat(whole_percent(F.coalesce(c, F.lit(0.0))).cast("string"), F.lit("%"))
    said = lambda c, short: F.concat(F.lit(" — "), F.substring(text(c), 1, short))
    name = lambda c: label_map(F.coalesce(c, F.lit("")), label)
    one = F.concat(F.lit("  • "), text(ticker), F.lit(" "), name(F.col("sentiment")), F.lit(" "), percent(F.col("confidence")), F.when(F.col("reason") != "", said("reason", 80)).otherwise(""))
    both = [F.when(F.col(f"{m}_sentiment").isNotNull(), F.concat(F.lit(f"\n      {title}："), name(F.col(f"{m}_sentiment")), F.lit(" "), percent(F.col(f"{m}_confidence")), said(f"{m}_reason", 70))).otherwise("") for m, title in (("primary", "主模型"), ("backup", "備用模型"))]
    section = F.when(F.col("diverged"), 1).when(F.col("n_models") == 2, 0).otherwise(2)
    line = F.when(F.col("diverged"), F.concat(F.lit("  • "), text(ticker), *both)).otherwise(one)
    lines = rows.select(report, section.alias("_s"), F.col(position).alias("_p"), line.alias("_line"))
    parts = lines.groupBy(report, "_s").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_p", "_line")))["_line"], "\n").alias("_text"))
    headed = F.concat(F.get(F.array(*[F.lit(h) for h in SECTION_HEADERS]), F.col("_s")), F.lit("\n"), F.col("_text"))
    return parts.groupBy(report).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_s", headed.alias("t"))))["t"], "\n\n").alias("text"))


def top_signals(rows: DataFrame, report: str, position: str, k: int, reason: Column, alternative: Column) -> DataFrame:
    """The first ``k`` of each report in order, with the reason or else its alternative, cut at 80 characters."""
    kept = first_k(rows, [report], [F.col(position)], k, rank="rank")
    return kept.withColumn("why", F.substring(F.coalesce(reason, alternative, F.lit("")), 1, 80))


def high_confidence(rows: DataFrame, least: float = HIGH_CONFIDENCE) -> DataFrame:
    return rows.where(F.col("confidence") >= least)


def whole_percent(confidence: Column) -> Column:
    """Confidence in percent, cut, not rounded."""
    return (confidence * 100).cast("int")


def direction_counts(rows: DataFrame, report: str, direction: str) -> DataFrame:
    """``analyzed``, ``bullish``, ``bearish`` and the ``neutral`` rest of each report; a rest of none is null."""
    is_ = lambda d: F.count_if(F.col(direction) == d)
    agg = rows.groupBy(report).agg(F.count("*").alias("analyzed"), is_("bullish").alias("bullish"), is_("bearish").alias("bearish"))
    rest = F.col("analyzed") - F.col("bullish") - F.col("bearish")
    return agg.withColumn("neutral", F.when(rest > 0, rest))


def analyzed_count(given: Column, signals: Column) -> Column:
    """The given count unless missing or zero, else the number of signals in the map."""
    return F.coalesce(F.nullif(given, F.lit(0)), F.greatest(F.size(signals), F.lit(0))).cast("long")


def key_events(events: Column, k: int = 3) -> Column:
    """The first ``k`` events that aren't boilerplate."""
    stop = F.array(*[F.lit(b) for b in BOILERPLATE])
    return F.slice(F.filter(events, lambda e: ~F.array_contains(stop, e)), 1, k)


def first_key_events(rows: DataFrame, keys: list[str], order: list[str], event: str, k: int = 3) -> DataFrame:
    """``keys`` and ``events``: the first ``k`` events of each key that aren't boilerplate, for events that come as rows.

    Only those are shuffled, so a key may hold any share of all rows; a key without one, or with null events only, has an empty array.
    """
    said = rows.select(*keys, *order, F.col(event).alias("_event")).where(~F.col("_event").isin(BOILERPLATE))
    kept = first_k(said, keys, [F.col(c) for c in order], k, "_nth").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_nth", "_event")))["_event"].alias("_found"))
    every = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = every.unionByName(kept, allowMissingColumns=True).groupBy(*keys).agg(F.max("_found").alias("_found"))
    return both.select(*keys, F.coalesce("_found", F.array().cast("array<string>")).alias("events"))


def weekly_rollup(rows: DataFrame, at: str, value: str, correct: Column) -> DataFrame:
    """For each day and each week (``day`` null): signals, mean, volatility, accuracy, first-to-last return."""
    day = F.to_date(at)
    keyed = rows.select(F.to_date(F.date_trunc("week", F.col(at))).alias("week"), day.alias("day"), F.col(at).alias("_at"), F.col(value).alias("_v"), correct.alias("_ok"))
    last, first = F.max_by("_v", "_at"), F.min_by("_v", "_at")
    return keyed.rollup("week", "day").agg(
        F.count("*").alias("n_signals"), F.avg("_v").alias("mean_value"), F.stddev_samp("_v").alias("volatility"),
        (F.count_if("_ok") / F.count("*")).alias("accuracy"), F.try_divide(last - first, first).alias("period_return"),
    ).where(F.col("week").isNotNull())


def label_map(code: Column, labels: dict[str, str], fold: bool = False) -> Column:
    """Code to label; unknown codes pass through.  ``fold`` looks codes up in lower case."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(code) if fold else code), code)


def outlook_filter(rows: DataFrame, outlook: str) -> DataFrame:
    """Rows whose outlook is worth showing: neither empty nor neutral."""
    return rows.where((F.col(outlook) != "") & (F.col(outlook) != "neutral"))


_COMMA = re.compile(r",\s*([}\]])")


def scan_object(text: str | None) -> str | None:
    """The first top-level ``{...}`` span by brace depth that is JSON, if need be without trailing commas."""
    depth, start = 0, 0
    for m in re.finditer(r"[{}]", text or ""):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                for candidate in (text[start : m.end()], _COMMA.sub(r"\1", text[start : m.end()])):
                    try:
                        json.loads(candidate)
                    except ValueError:
                        continue
                    return candidate
    return None


def lenient_json(rows: DataFrame, text: str, into: str = "object") -> DataFrame:
    """``rows`` with the JSON object that stands somewhere in ``text``, as JSON text; null if there is none.

    Fences go, then the outermost braces are tried as they are and without trailing commas, all in the engine.  Only
    texts that still have braces and no object reach the scanner, in Arrow batches that hold null for the others.
    """
    scanner = F.pandas_udf(_scan_batch, "string")
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(text)), r"^```[^\n]*\n", ""), r"\n```\s*$", "")
    span = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    clean = F.regexp_replace(span, r",\s*([}\]])", "$1")
    rows = rows.withColumns({"_bare": bare, "_span": span, "_clean": clean})
    whole = F.when(F.try_parse_json("_span").isNotNull(), F.col("_span")).when(F.try_parse_json("_clean").isNotNull(), F.col("_clean"))
    rows = rows.withColumn("_whole", whole)
    left = F.when(F.col("_whole").isNull() & F.col("_span").isNotNull(), F.col("_bare"))
    return rows.withColumn(into, F.coalesce("_whole", scanner(left))).drop("_bare", "_span", "_clean", "_whole")


def _scan_batch(texts: pd.Series) -> pd.Series:
    return texts.map(scan_object, na_action="ignore")


def model_output_rows(rows: DataFrame, object_text: str, keys: list[str]) -> DataFrame:
    """One row for each ticker of a model's answer: ``ticker``, ``sentiment``, ``confidence`` (unparseable: 0), ``reason``."""
    parsed = F.from_json(object_text, "map<string, struct<sentiment: string, confidence: string, reason: string>>")
    out = rows.select(*keys, F.explode(parsed).alias("ticker", "s"))
    return out.select(*keys, "ticker", "s.sentiment", F.coalesce(F.col("s.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), "s.reason")


def ticker_context(quotes: DataFrame, headlines: DataFrame, key: str, k: int = 3) -> DataFrame:
    """A text block for each ticker: its price line or ``unavailable``, then up to ``k`` headlines in order."""
    top = first_k(headlines, [key], [F.col("position")], k, rank="_nth")
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_nth", "title"))).alias("_t"))
    price = F.coalesce(F.col("price").cast("string"), F.lit("unavailable"))
    lines = F.transform(F.coalesce(F.col("_t.title"), F.array().cast("array<string>")), lambda t: F.concat(F.lit("- "), t))
    head = F.concat(F.col(key).cast("string"), F.lit(": "), price)
    return quotes.join(listed, key, "left").select(key, F.array_join(F.concat(F.array(head), lines), "\n").alias("context"))
