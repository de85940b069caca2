"""Queries of the quote operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnframe.operators import quotes
from dawnframe.plans.registry import query
from dawnframe.tables import table

PART_TEXT = "CASE WHEN p_partkey % 10 = 0 THEN '-' ELSE CAST(p_retailprice AS VARCHAR) END"
PREVIOUS = "CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END"


@query(
    "q1_quote_change",
    f"""WITH q AS (SELECT p_partkey, TRY_CAST({PART_TEXT} AS DOUBLE) AS z, TRY_CAST({PREVIOUS} AS DOUBLE) AS y FROM part)
    SELECT p_partkey, CASE WHEN y <> 0 THEN round(z - y, 6) END AS change, CASE WHEN y <> 0 THEN round((z - y) / y * 100, 6) END AS change_pct FROM q""",
)
def q1(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 10 == 0, "-").otherwise(F.col("p_retailprice").cast("string"))
    previous = F.when(F.col("p_partkey") % 7 == 0, "0").otherwise(F.col("p_size").cast("string"))
    found = quotes.quote_change(part, price, previous)
    return found.select("p_partkey", F.round("change", 6).alias("change"), F.round("change_pct", 6).alias("change_pct"))


@query(
    "q1_change_text",
    f"""WITH q AS (SELECT p_partkey, TRY_CAST({PART_TEXT} AS DOUBLE) AS z, TRY_CAST({PREVIOUS} AS DOUBLE) AS y FROM part), c AS (SELECT p_partkey, z - y AS change, CASE WHEN y <> 0 THEN (z - y) / y * 100 END AS pct, CASE WHEN z >= y THEN '+' ELSE '' END AS sign FROM q)
    SELECT p_partkey, CASE WHEN pct IS NULL THEN '' ELSE sign || printf('%.2f', round(change, 2)) || ' (' || sign || printf('%.2f', round(pct, 2)) || '%)' END AS text FROM c""",
)
def q1_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 10 == 0, "-").otherwise(F.col("p_retailprice").cast("string"))
    previous = F.when(F.col("p_partkey") % 7 == 0, "0").otherwise(F.col("p_size").cast("string"))
    found = quotes.quote_change(part, price, previous)
    return found.select("p_partkey", quotes.change_text(F.col("change"), F.col("change_pct")).alias("text"))


@query(
    "q2_quote_change_grouped",
    """SELECT c_custkey, round(c_acctbal - 1000.5, 4) AS change, round((c_acctbal - 1000.5) / 1000.5 * 100, 4) AS change_pct FROM customer""",
)
def q2(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("last", F.format_number("c_acctbal", 2))
    found = quotes.quote_change(rows, F.col("last"), F.lit("1,000.50"))
    return found.select("c_custkey", F.round("change", 4).alias("change"), F.round("change_pct", 4).alias("change_pct"))




@query(
    "q3_quote_from_closes",
    """WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, list(value ORDER BY event_id) FILTER (event_type <> 'error') AS c, max(value) AS market, min(value) AS prev FROM events GROUP BY 1, 2),
    q AS (SELECT user_id, day, CASE WHEN coalesce(len(c), 0) >= 2 THEN c[-1] ELSE coalesce(nullif(market, 0), c[-1]) END AS cur, CASE WHEN coalesce(len(c), 0) >= 2 THEN c[-2] ELSE nullif(prev, 0) END AS prv FROM h)
    SELECT user_id || ' ' || day AS symbol, round(cur, 2) AS price, round(prv, 2) AS prev_close, round((cur - prv) / prv * 100, 2) AS pct_change FROM q WHERE cur <> 0 AND prv <> 0""",
)
def q3(spark, sf_dir):
    close = F.when(F.col("event_type") != "error", F.col("value"))
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value", close.alias("close"))
    newest = quotes.newest_closes(rows, ["user_id", "day"], ["event_id"], "close")
    fields = rows.groupBy("user_id", "day").agg(F.max("value").alias("market"), F.min("value").alias("prev")).join(newest, ["user_id", "day"], "left")
    fields = fields.withColumn("symbol", F.concat_ws(" ", F.col("user_id").cast("string"), F.col("day").cast("string")))
    return quotes.quote_from_closes(fields, "symbol", F.coalesce("closes", F.array().cast("array<double>")), F.col("market"), F.col("prev"), F.lit(None).cast("double"))


@query(
    "q4_quote_with_fallback",
    """WITH p AS (SELECT s_nationkey AS nation, max(s_acctbal) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), s AS (SELECT c_nationkey AS nation, max(c_acctbal) AS v FROM customer GROUP BY 1)
    SELECT nation, coalesce(p.v, s.v) AS price, CASE WHEN p.v IS NOT NULL THEN 'primary' WHEN s.v IS NOT NULL THEN 'secondary' END AS source FROM p FULL JOIN s USING (nation)""",
)
def q4(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_acctbal").alias("price"))
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("c_acctbal").alias("price"))
    return quotes.quote_with_fallback(p, s, "nation", "price")


@query(
    "q5_index_or_nodata",
    """WITH u AS (SELECT user_id, list(CASE WHEN user_id % 3 <> 0 THEN value END) AS places, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 0.0 ELSE round(max(value), 4) END AS idx FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN idx IS NULL OR (idx = 0 AND user_id % 3 = 0) THEN -1.0 ELSE idx END AS index FROM u""",
)
def q5(spark, sf_dir):
    user = F.col("user_id")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.max(F.when(user % 3 != 0, F.col("value"))).alias("place"))
    index = F.when(user % 5 == 0, None).when(user % 2 == 0, 0.0).otherwise(F.round("top", 4))
    return rows.select("user_id", quotes.index_or_nodata(index, F.array("place")).alias("index"))


@query("q6_market_filter", "SELECT c_custkey, c_name, r_name AS market FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia'")
def q6(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return quotes.market_filter(rows.select("c_custkey", "c_name", F.col("r_name").alias("market")), F.col("market"), "asia")


@query(
    "q7_parse_ticker_list",
    r"""WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(CASE WHEN doc_id % 11 = 0 THEN '' ELSE regexp_replace(text, '[^a-z ]', ' ', 'g') END, '\s+'), lambda x: x <> ''), lambda x: upper(x)) AS f FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE ['AAPL', 'MSFT'] END, ' ') AS tickers FROM t""",
)
def q7(spark, sf_dir):
    words = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.regexp_replace("text", "[^a-z ]", " "))
    stored = F.concat(F.lit("signals:tickers: "), words)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(quotes.parse_ticker_list(stored, ["AAPL", "MSFT"]), " ").alias("tickers"))
