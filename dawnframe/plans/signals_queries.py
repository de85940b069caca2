"""Queries of the signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnframe.operators import signals
from dawnframe.plans.registry import query
from dawnframe.tables import table

MODELS_SQL = """
t AS (SELECT doc_id, lang FROM documents),
p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'bullish' ELSE 'bearish' END AS s, round(0.5 + (doc_id % 50) / 100.0, 4) AS c, '' AS r FROM labels),
b AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'bullish' ELSE 'bearish' END AS s, round(0.3 + (doc_id % 60) / 100.0, 4) AS c, source AS r FROM documents WHERE doc_id % 3 <> 0),
m AS (SELECT t.doc_id, t.lang, coalesce(p.s, b.s) AS sentiment,
  CASE WHEN p.s = b.s THEN (p.c + b.c) / 2 WHEN p.s IS NOT NULL THEN p.c ELSE b.c END AS confidence, coalesce(nullif(p.r, ''), nullif(b.r, ''), '') AS reason,
  coalesce(p.s <> b.s, false) AS diverged, CAST((p.s IS NOT NULL) AS INT) + CAST((b.s IS NOT NULL) AS INT) AS n_models,
  p.s AS primary_sentiment, p.c AS primary_confidence, p.r AS primary_reason, b.s AS backup_sentiment, b.c AS backup_confidence, b.r AS backup_reason
  FROM t LEFT JOIN p USING (doc_id) LEFT JOIN b USING (doc_id) WHERE p.s IS NOT NULL OR b.s IS NOT NULL)"""


def merged(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    share = lambda base, n: F.round(F.lit(base) + (F.col("doc_id") % n) / 100.0, 4)
    side = lambda good: F.when(good, "Bullish").otherwise("Bearish")
    primary = labels.select("doc_id", side(F.col("quality") == 1).alias("sentiment"), share(0.5, 50).alias("confidence"), F.lit("").alias("reason"))
    backup = docs.where("doc_id % 3 <> 0").select("doc_id", side(F.col("n_chars") > 1000).alias("sentiment"), share(0.3, 60).alias("confidence"), F.col("source").alias("reason"))
    return signals.merge_models(docs.select("doc_id", "lang"), primary, backup, "doc_id")


def _even(rows):
    return rows.withColumn("confidence", F.round("confidence", 6))


COLUMNS = "doc_id, lang, sentiment, round(confidence, 6) AS confidence, reason, diverged, n_models, primary_sentiment, primary_confidence, primary_reason, backup_sentiment, backup_confidence, backup_reason"


@query("s1_merge_models", f"WITH {MODELS_SQL} SELECT {COLUMNS} FROM m")
def s1(spark, sf_dir):
    return _even(merged(spark, sf_dir))


@query("s2_rank_signals", f"WITH {MODELS_SQL} SELECT {COLUMNS}, row_number() OVER (PARTITION BY lang ORDER BY diverged DESC, confidence DESC, doc_id) AS rank FROM m")
def s2(spark, sf_dir):
    return _even(signals.rank_signals(merged(spark, sf_dir), "lang", "doc_id"))


NAMES = {"bullish": "看漲", "bearish": "看跌"}


@query(
    "s3_report_text",
    f"""WITH {MODELS_SQL}, e AS (SELECT *, doc_id // 50 AS report, CASE WHEN diverged THEN 1 WHEN n_models = 2 THEN 0 ELSE 2 END AS sec FROM m),
    n AS (SELECT report, sec, doc_id, CASE WHEN sec = 1 THEN '  • ' || doc_id || chr(10) || '      主模型：' || CASE primary_sentiment WHEN 'bullish' THEN '看漲' ELSE '看跌' END || ' ' || CAST(trunc(primary_confidence * 100) AS INT) || '% — ' || substr(primary_reason, 1, 70)
      || chr(10) || '      備用模型：' || CASE backup_sentiment WHEN 'bullish' THEN '看漲' ELSE '看跌' END || ' ' || CAST(trunc(backup_confidence * 100) AS INT) || '% — ' || substr(coalesce(backup_reason, ''), 1, 70)
      ELSE '  • ' || doc_id || ' ' || CASE sentiment WHEN 'bullish' THEN '看漲' ELSE '看跌' END || ' ' || CAST(trunc(confidence * 100) AS INT) || '%' || CASE WHEN reason <> '' THEN ' — ' || substr(reason, 1, 80) ELSE '' END END AS line FROM e),
    g AS (SELECT report, sec, CASE sec WHEN 0 THEN '🎯 共識訊號' WHEN 1 THEN '⚠️ 分歧訊號' ELSE '📊 單一參考' END || chr(10) || string_agg(line, chr(10) ORDER BY doc_id) AS t FROM n GROUP BY 1, 2)
    SELECT report, string_agg(t, chr(10) || chr(10) ORDER BY sec) AS text FROM g GROUP BY 1""",
)
def s3_report(spark, sf_dir):
    rows = merged(spark, sf_dir).withColumn("report", F.floor(F.col("doc_id") / 50))
    return signals.report_text(rows, "report", "doc_id", "doc_id", NAMES)


@query("s3_signal_section", f"WITH {MODELS_SQL} SELECT CASE WHEN diverged THEN 'diverged' ELSE 'consensus' END AS section, n_models, count(*) AS n FROM m GROUP BY 1, 2")
def s3(spark, sf_dir):
    return signals.signal_section(merged(spark, sf_dir)).groupBy("section", "n_models").agg(F.count("*").alias("n"))


@query(
    "s4_top_signals",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events) SELECT user_id, rank, event_id, substr(CASE WHEN event_type = 'error' THEN props ELSE event_type END, 1, 80) AS why FROM r WHERE rank <= 5",
)
def s4(spark, sf_dir):
    reason = F.when(F.col("event_type") != "error", F.col("event_type"))
    return signals.top_signals(table(spark, sf_dir, "events"), "user_id", "event_id", 5, reason, F.col("props")).select("user_id", "rank", "event_id", "why")


CONFIDENCE = "least(value / 20.0, 1.0)"


@query("s5_high_confidence", f"SELECT event_id, round({CONFIDENCE}, 6) AS confidence, CAST(floor({CONFIDENCE} * 100) AS INT) AS percent FROM events WHERE {CONFIDENCE} >= 0.7")
def s5(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.least(F.col("value") / 20.0, F.lit(1.0)).alias("confidence"))
    kept = signals.high_confidence(rows)
    return kept.select("event_id", F.round("confidence", 6).alias("confidence"), signals.whole_percent(F.col("confidence")).alias("percent"))


SIDE = "CASE WHEN event_type = 'purchase' THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' ELSE 'neutral' END"


@query(
    "s6_direction_counts",
    f"""WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {SIDE} AS side FROM events)
    SELECT day, count(*) AS analyzed, count(*) FILTER (side = 'bullish') AS bullish, count(*) FILTER (side = 'bearish') AS bearish, nullif(count(*) FILTER (side = 'neutral'), 0) AS neutral FROM d GROUP BY day""",
)
def s6(spark, sf_dir):
    side = F.when(F.col("event_type") == "purchase", "bullish").when(F.col("event_type") == "error", "bearish").otherwise("neutral")
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), side.alias("side"))
    return signals.direction_counts(rows, "day", "side")


@query(
    "s7_analyzed_count",
    "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN count(*) ELSE count(DISTINCT event_type) END AS analyzed FROM events GROUP BY user_id",
)
def s7(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.collect_set("event_type").alias("kinds"))
    given = F.when(F.col("user_id") % 2 == 0, F.col("n")).otherwise(0)
    by_kind = F.map_from_arrays("kinds", "kinds")
    return rows.select("user_id", signals.analyzed_count(given, by_kind).alias("analyzed"))


@query(
    "s8_key_events",
    """WITH u AS (SELECT user_id, CAST(ts AS DATE) AS d, list(CASE WHEN event_type = 'view' THEN 'Market closed' ELSE event_type || ' ' || event_id END ORDER BY event_id) AS l FROM events GROUP BY 1, 2)
    SELECT user_id, CAST(d AS VARCHAR) AS day, array_to_string(list_slice(list_filter(l, lambda x: x <> 'Market closed'), 1, 3), '; ') AS events FROM u""",
)
def s8(spark, sf_dir):
    said = F.when(F.col("event_type") == "view", "Market closed").otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", said.alias("said"))
    return signals.first_key_events(rows, ["user_id", "day"], ["event_id"], "said").select("user_id", "day", F.array_join("events", "; ").alias("events"))


@query(
    "s9_weekly_rollup",
    """WITH e AS (SELECT date_trunc('week', ts) AS w, CAST(ts AS DATE) AS d, ts, value, event_type FROM events)
    SELECT CAST(CAST(w AS DATE) AS VARCHAR) AS week, CAST(d AS VARCHAR) AS day, count(*) AS n_signals, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS volatility,
    round(count(*) FILTER (event_type <> 'error') * 1.0 / count(*), 6) AS accuracy, round((arg_max(value, ts) - arg_min(value, ts)) / nullif(arg_min(value, ts), 0), 6) AS period_return
    FROM e GROUP BY GROUPING SETS ((w, d), (w))""",
)
def s9(spark, sf_dir):
    found = signals.weekly_rollup(table(spark, sf_dir, "events"), "ts", "value", F.col("event_type") != "error")
    even = {c: F.round(c, 6) for c in ("mean_value", "volatility", "accuracy", "period_return")}
    return found.withColumns(even | {c: F.col(c).cast("string") for c in ("week", "day")})


@query(
    "s10_label_map",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE event_type END AS exact, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE upper(event_type) END AS folded FROM events",
)
def s10(spark, sf_dir):
    names = {"click": "Click", "view": "View"}
    exact, folded = signals.label_map(F.col("event_type"), names), signals.label_map(F.upper("event_type"), names, fold=True)
    return table(spark, sf_dir, "events").select("event_id", exact.alias("exact"), folded.alias("folded"))


@query("s11_outlook_filter", "SELECT event_id, event_type AS outlook FROM events WHERE event_type NOT IN ('view', 'error')")
def s11(spark, sf_dir):
    outlook = F.when(F.col("event_type") == "view", "neutral").when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return signals.outlook_filter(table(spark, sf_dir, "events").select("event_id", outlook.alias("outlook")), "outlook")


def _noisy(spark, sf_dir):
    """Event properties as a model would wrap them: plain, fenced, in prose, with a trailing comma, after a broken one, none."""
    kind, props = F.col("event_id") % 6, F.col("props")
    text = (
        F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), props, F.lit(" done")))
        .when(kind == 3, F.replace(props, F.lit("}"), F.lit(", }"))).when(kind == 4, F.concat(F.lit("{broken: } then "), props)).otherwise("no object")
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("s12_lenient_json", "SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def s12(spark, sf_dir):
    return signals.lenient_json(_noisy(spark, sf_dir), "text").select("event_id", F.get_json_object("object", "$.k").cast("long").alias("k"))


@query(
    "s13_model_output_rows",
    "SELECT event_id, event_type AS ticker, CASE WHEN value > 5 THEN 'bullish' ELSE 'bearish' END AS sentiment, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 0.75 END AS DOUBLE) AS confidence, 'r' || user_id AS reason FROM events",
)
def s13(spark, sf_dir):
    entry = F.struct(
        F.when(F.col("value") > 5, "bullish").otherwise("bearish").alias("sentiment"),
        F.when(F.col("event_id") % 4 == 0, "high").otherwise("0.75").alias("confidence"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("reason"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.create_map(F.col("event_type"), entry)).alias("object"))
    return signals.model_output_rows(rows, "object", ["event_id"])


@query(
    "s14_ticker_context",
    """WITH o AS (SELECT o_custkey AS k, o_orderpriority || ' ' || o_orderkey AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
    h AS (SELECT k, string_agg('- ' || title, chr(10) ORDER BY nth) AS t FROM o WHERE nth <= 3 GROUP BY k)
    SELECT c_custkey AS ticker, c_custkey || ': ' || CASE WHEN c_custkey % 4 = 0 THEN 'unavailable' ELSE c_mktsegment END || coalesce(chr(10) || h.t, '') AS context FROM customer LEFT JOIN h ON k = c_custkey""",
)
def s14(spark, sf_dir):
    price = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    quotes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), price.alias("price"))
    title = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("position"), title.alias("title"))
    return signals.ticker_context(quotes, lines, "ticker")
