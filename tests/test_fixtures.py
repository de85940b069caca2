"""Small fixtures with known results: the rules that the tables of the queries don't reach."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from dawnframe.functions import exprs
from dawnframe.operators import keyed, markdown, news, places, quotes, registry, runs, series, signals, topk
from dawnframe.sources import charts, feeds, logs


def one(spark, column, **values):
    """The value of an expression over one row."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column.alias("x")).first().x


def prices(spark, rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), float(c)) for s, d, c in rows], "symbol string, date date, close double")


WTI = [("WTI", "2026-04-14", 77.0), ("WTI", "2026-04-15", 78.2)]


def test_window_is_newest_rows_oldest_first(spark):
    rows = prices(spark, [("CL=F", "2026-04-13", 77), ("CL=F", "2026-04-14", 78), ("CL=F", "2026-04-15", 79)])
    assert [(r.close, r.position) for r in series.window_last_n(rows, 2).orderBy("position").collect()] == [(78.0, 0), (79.0, 1)]


def test_upsert_last_write_wins_and_is_idempotent(spark):
    base, batch = prices(spark, [("CL=F", "2026-04-15", 78.2)]), prices(spark, [("CL=F", "2026-04-15", 79.4)])
    once = series.upsert_series(base, batch)
    assert [r.close for r in once.collect()] == [79.4]
    assert [r.close for r in series.upsert_series(once, batch).collect()] == [79.4]
    assert series.latest_row(once).first().close == 79.4


def test_upsert_orders_the_rows_of_a_batch(spark):
    batch = prices(spark, [("A", "2026-01-01", 1), ("A", "2026-01-01", 2)]).withColumn("batch_seq", F.col("close").cast("int"))
    assert [r.close for r in series.upsert_series(prices(spark, []), batch).collect()] == [2.0]


def test_backfill(spark):
    symbols = spark.createDataFrame([("CL=F",)], "symbol string")
    assert series.needs_backfill(symbols, prices(spark, [])).count() == 1
    assert series.needs_backfill(symbols, prices(spark, [("CL=F", "2026-04-15", 1)])).count() == 0


@pytest.mark.parametrize(("brent", "ho", "marks"), [((80.0, 80.64), (2.40, 2.45), {"Brent": "agree", "HO": "agree"}), ((80.0, 79.6), (2.40, 2.45), {"Brent": "disagree", "HO": "agree"})])
def test_confirmation(spark, brent, ho, marks):
    rows = WTI + [(s, d, c) for s, cs in (("Brent", brent), ("HO", ho)) for d, c in zip(("2026-04-14", "2026-04-15"), cs, strict=True)]
    found = series.regime_snapshot(prices(spark, rows), "WTI").collect()
    assert {r.symbol: r.mark for r in found} == marks | {"WTI": "lead"}
    assert round(next(r.change_pct for r in found if r.symbol == "WTI"), 1) == 1.6


def test_flat_lead_and_missing_window(spark):
    rows = [("WTI", "2026-04-14", 77), ("WTI", "2026-04-15", 77), ("Brent", "2026-04-14", 80), ("Brent", "2026-04-15", 80.5), ("HO", "2026-04-15", 2.4)]
    found = {r.symbol: r.mark for r in series.confirmation(series.change_pct(prices(spark, rows)), "WTI").collect()}
    assert found == {"Brent": "flat", "HO": "n/a"}


def test_extremes_take_the_earliest_of_ties(spark):
    rows = prices(spark, [("A", f"2026-01-0{i + 1}", c) for i, c in enumerate((5, 9, 9, 3, 3))])
    found = series.metrics(series.window_last_n(rows)).first()
    assert (found.high_day.day, found.rows_since_high, found.low_day.day, found.rows_since_low) == (2, 3, 4, 1)


def test_history_gate(spark):
    rows = [("A", f"2026-01-{i + 1:02d}", 1) for i in range(19)] + [("B", f"2026-01-{i + 1:02d}", 1) for i in range(20)]
    found = {r.symbol: r.status for r in series.min_history_gate(prices(spark, rows), "A").collect()}
    assert found == {"A": "error", "B": "ok"}


def test_record_gate(spark):
    state = spark.createDataFrame([("WTI", 1.0, False), ("HO", 1.0, True)], "symbol string, close double, stale boolean")
    need = lambda *names: spark.createDataFrame([(n,) for n in names], "symbol string")
    assert series.record_gate(state, need("WTI", "HO")).count() == 0
    assert series.record_gate(state, need("WTI")).count() == 2
    assert series.record_gate(state, need("WTI", "BZ")).count() == 0


def chart(times, closes, **meta):
    return json.dumps({"chart": {"result": [{"meta": meta, "timestamp": times, "indicators": {"quote": [{"close": closes}]}}]}})


def test_chart_rows(spark):
    raw = spark.createDataFrame([("CL=F", chart([1713139200, 1713225600, 1713312000], [82.2, None, 83.4])), ("X", "{}"), ("Y", "broken"), ("Z", chart([1713139200], [1.0, 2.0]))], "symbol string, payload string")
    found = [(r.symbol, str(r.date), r.close) for r in charts.chart_rows(raw).orderBy("symbol", "date").collect()]
    assert found == [("CL=F", "2024-04-15", 82.2), ("CL=F", "2024-04-17", 83.4), ("Z", "2024-04-15", 1.0)]


def test_quotes(spark):
    rows = spark.createDataFrame([("-", "10"), ("5", "0"), ("24,750.79", "24,382.47")], "last string, prv string")
    found = [(r.change and round(r.change, 2), r.change_pct and round(r.change_pct, 2)) for r in quotes.quote_change(rows, F.col("last"), F.col("prv")).collect()]
    assert found == [(None, None), (None, None), (368.32, 1.51)]
    closes = spark.createDataFrame([("A", [12.0], 0.0, 10.0)], "k string, c array<double>, p double, cp double")
    got = quotes.quote_from_closes(closes, "k", F.col("c"), F.lit(12.0), F.col("p"), F.col("cp")).first()
    assert (got.price, got.prev_close, got.pct_change) == (12.0, 10.0, 20.0)


@pytest.mark.parametrize(("index", "places_", "want"), [(0.0, [None, None], -1.0), (0.0, [None, 0], 0.0), (0.0, [], -1.0), (None, [1], -1.0), (3.0, [None], 3.0)])
def test_index_or_nodata(spark, index, places_, want):
    row = spark.createDataFrame([(index, places_)], "i double, p array<int>")
    assert row.select(quotes.index_or_nodata(F.col("i"), F.col("p")).alias("x")).first().x == want


@pytest.mark.parametrize(("text", "want"), [("desk:tickers: aapl  MSFT", ["AAPL", "MSFT"]), ("tickers: tsla", ["TSLA"]), ("desk:tickers:", ["D"]), ("", ["D"]), ("nvda", ["NVDA"])])
def test_ticker_list(spark, text, want):
    assert one(spark, quotes.parse_ticker_list(F.col("t"), ["D"]), t=text) == want


def test_two_model_merge(spark):
    tickers = spark.createDataFrame([(i, t, "r") for i, t in enumerate("ABCD")], "pos int, ticker string, report string")
    schema = "ticker string, sentiment string, confidence double, reason string"
    primary = spark.createDataFrame([("A", "bullish", 0.8, ""), ("B", "bullish", 0.9, "x")], schema)
    backup = spark.createDataFrame([("A", "Bullish", 0.6, "y"), ("B", "bearish", 0.5, ""), ("C", "neutral", 0.4, None)], schema)
    found = signals.rank_signals(signals.merge_models(tickers, primary, backup), "report", "pos").orderBy("rank").collect()
    assert [(r.ticker, r.sentiment, round(r.confidence, 2), r.diverged, r.n_models, r.reason) for r in found] == [("B", "bullish", 0.9, True, 2, "x"), ("A", "bullish", 0.7, False, 2, "y"), ("C", "neutral", 0.4, False, 1, "")]


def test_lenient_json(spark):
    texts = ['{"k": 1}', '```json\n{"k": 2}\n```', 'so: {"k": 3} ok', '{"k": 4,}', '{"a": } {"k": 5}', "none", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: r.object for r in signals.lenient_json(rows, "t").collect()}
    assert [found[i] and json.loads(found[i])["k"] for i in range(7)] == [1, 2, 3, 4, 5, None, None]


RSS = "<rss><channel><item><title> A </title><link>u</link></item><item><title>B</title></item><item><title>  </title><link>v</link></item><item><title>C</title><link>w</link><source>S</source></item></channel></rss>"


def test_rss(spark):
    raw = spark.createDataFrame([("f", RSS), ("bad", "<rss><channel><item>"), ("one", "<rss><channel><item><title>x</title><link>y</link></item></channel></rss>"), ("null", None)], "feed string, raw string")
    assert [(r.feed, r.title, r.link) for r in feeds.rss_items(raw, "feed", "raw", 15).orderBy("feed", "position").collect()] == [("f", "A", "u"), ("f", "B", ""), ("f", "C", "w"), ("one", "x", "y")]
    assert [(r.title.strip(), r.source) for r in feeds.rss_items_with_source(raw.where("feed = 'f'"), "feed", "raw").orderBy("position").collect()] == [("A", "Google News"), ("", "Google News"), ("C", "S")]


def test_titles_keep_first(spark):
    rows = spark.createDataFrame([(1, 0, 0, "AI News", "s"), (2, 1, 0, "ai news", "s"), (3, 1, 1, "Other", "s")], "id int, feed_order int, position int, title string, section string")
    assert sorted(r.id for r in news.dedup_titles(rows, "section", "title", ["feed_order", "position"], "id").collect()) == [1, 3]


def test_references(spark):
    rows = spark.createDataFrame([(1, "r", "- #1 x"), (2, "r", "- #9 y"), (3, "r", "plain")], "id int, report string, body string")
    items = spark.createDataFrame([("r", 1, "http://a")], "report string, n long, link string")
    assert {r.id: r.body for r in news.resolve_refs(rows, "id", "report", "body", items).collect()} == {1: "- [🔗](http://a) x", 2: "- y", 3: "plain"}
    sourced = spark.createDataFrame([(1, "r", "a [來源 #1] b [來源 #9]")], "id int, report string, body string")
    known = spark.createDataFrame([("r", 1, "S", "http://a")], "report string, n long, source string, url string")
    assert news.resolve_source_refs(sourced, "id", "report", "body", known).first().body == "a [S](http://a) b [來源 #9]"


@pytest.mark.parametrize(
    ("md", "want"),
    [("# T\n\n> one\n> two\n\n> three", "one two"), ("# T\n\nfirst line\nsecond\n\nlater", "first line second"), ("", markdown.NO_SUMMARY), ("> \n> q\r\ntext", "q"), ("x" * 101, "x" * 100 + "..."), (None, markdown.NO_SUMMARY)],
)
def test_intro_summary(spark, md, want):
    row = spark.createDataFrame([(md,)], "m string")
    assert row.select(markdown.intro_summary(F.col("m")).alias("x")).first().x == want


def test_markdown_features(spark):
    links = " ".join(f"[t](http://x/{i})" for i in (1, 1, 2, 3, 3, 4, 5, 6, 7))
    assert one(spark, markdown.extract_links(F.col("m")), m=links) == [f"http://x/{i}" for i in range(1, 6)]
    assert one(spark, markdown.first_heading(F.col("m")), m="a\n# One \n# Two") == "One"
    for value, want in (("YOUR_KEY", True), ("abcTOKEN_HERE", True), ("  ", True), ("sk-live", False)):
        assert one(spark, markdown.is_placeholder(F.col("v")), v=value) is want


@pytest.mark.parametrize(("q", "want"), [("正念 數位", "zh-TW"), ("mindfulness AI", "en-US")])
def test_locale(spark, q, want):
    assert one(spark, news.locale_route(F.col("q")), q=q) == want


def test_query_encoding(spark):
    assert one(spark, news.encode_query(F.col("q")), q="CL=F a/b~c*") == "CL%3DF%20a%2Fb~c%2A"
    assert one(spark, news.encode_query(F.col("q"), keep_slash=True), q="a/b") == "a/b"


def test_nearest_in_time(spark):
    rows = spark.createDataFrame([("p", "Wx", 0, "soon"), ("p", "Wx", 1, "2026-01-01 10:00:00"), ("p", "Wx", 2, "2026-01-01 12:00:00"), ("q", "Wx", 0, "never")], "location string, element string, idx long, start string")
    now = F.lit("2026-01-01 03:00:00").cast("timestamp")  # 11:00 at +08:00: a tie
    assert {r.location: r.idx for r in places.nearest_in_time(rows, "location", now).collect()} == {"p": 1, "q": 0}


def test_locations_and_minutes(spark):
    known = spark.createDataFrame([("home", "1,2")], "name string, coord string")
    rows = spark.createDataFrame([("home",), ("25.1,121.5",), ("25.1,x",), ("nowhere",)], "place string")
    assert {r.place: r.coord for r in places.resolve_location(rows, "place", known).collect()} == {"home": "1,2", "25.1,121.5": "25.1,121.5", "25.1,x": None, "nowhere": None}
    assert [one(spark, places.travel_minutes(F.col("s")), s=s) for s in (150, 210)] == [2, 4]


def history(spark):
    rows = [(1, "p", "k", "s", "2026-01-01"), (2, "p", "k", "t", "2026-01-02"), (3, "p", "j", "s", "2026-01-02"), (4, "o", "k", "s", "2026-01-03")]
    return spark.createDataFrame([(i, p, k, s, dt.date.fromisoformat(d)) for i, p, k, s, d in rows], "id long, persona_slug string, skill string, stream string, date date")


def test_recent(spark):
    rows = history(spark)
    ids = lambda **by: [r.id for r in registry.recent(rows, **by).collect()]
    assert ids(persona="p") == [3, 2, 1]
    assert ids(persona="p", k=2) == [3, 2]
    assert ids(skill="k", stream="s") == [4, 1]
    with pytest.raises(ValueError):
        registry.recent(rows)
    with pytest.raises(ValueError):
        registry.recent(rows, persona="p", k=0)
    assert sorted(r.id for r in registry.recent_of_all(rows, "persona_slug", 1).collect()) == [3, 4]


def test_content_hash(spark):
    none = F.lit(None).cast("string")
    fields = dict.fromkeys(registry.HASHED, none) | {"slug": F.lit("demo-writer"), "role": F.lit("作家"), "expression": F.lit('a "quoted" line\nsecond')}
    assert one(spark, registry.content_hash(fields)) == "sha256:1b2984749eab27b0"
    with pytest.raises(ValueError):
        registry.content_hash(fields, 2)
    a = one(spark, registry.content_hash_any(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))))
    assert a == "sha256:" + hashlib.sha256(json.dumps({"a": "2", "b": "1"}).encode()).hexdigest()[:16]


def test_record_rules(spark):
    rows = [("demo", "r", ["slug"], "demo"), ("demo", "r", ["secrets"], "demo"), ("demo", "r", ["x"], "demo"), ("demo", " ", ["slug"], "demo"), ("demo", "r", ["slug"], "other"), ("Bad", "r", ["slug"], "Bad")]
    frame = spark.createDataFrame(rows, "slug string, role string, keys array<string>, stem string")
    valid, rejected = logs.validate_records(frame, logs.record_rules(F.col("stem"), ["slug", "role"]))
    assert valid.count() == 1
    assert sorted(r.reasons[0] for r in rejected.collect()) == ["bad slug", "forbidden key", "role is missing", "slug differs from its source", "unknown key"]


def test_transition_refuses_the_second_time(spark):
    rows = spark.createDataFrame([(1, "planned", None), (2, "published", 5)], "id long, status string, history_id long")
    asked = spark.createDataFrame([(1, "published", 7), (2, "skipped", None), (3, "skipped", None)], "id long, new_status string, history_id long")
    moved, refused = keyed.transition(rows, asked, "id", "planned")
    assert {r.id: (r.status, r.history_id) for r in moved.collect()} == {1: ("published", 7), 2: ("published", 5)}
    assert sorted(r.id for r in refused.collect()) == [2, 3]
    again, refused = keyed.transition(moved, asked, "id", "planned")
    assert refused.count() == 3
    assert {r.id: r.status for r in again.collect()} == {1: "published", 2: "published"}


def test_upsert_entity_keeps_created(spark):
    day = lambda d: F.lit(d).cast("date")
    base = spark.createDataFrame([("a", "x", "p")], "slug string, role string, preview string").withColumns({"created_at": day("2026-01-01"), "updated_at": day("2026-01-01")})
    batch = spark.createDataFrame([("a", "y", "q"), ("b", "z", "r")], "slug string, role string, preview string")
    found = {r.slug: r for r in keyed.upsert_entity(base, batch, "slug", day("2026-02-02"), ("preview",)).collect()}
    assert (found["a"].role, str(found["a"].created_at), str(found["a"].updated_at), found["a"].preview) == ("y", "2026-01-01", "2026-02-02", None)
    assert str(found["b"].created_at) == "2026-02-02"


def test_next_planned_and_series_split(spark):
    rows = spark.createDataFrame([(1, "p", 0, "skipped"), (2, "p", 1, "planned"), (3, "p", 2, "planned")], "id long, plan string, week int, status string")
    assert registry.next_planned(rows, "plan", "week", "id").first().id == 2


def test_run_outcome_precedence(spark):
    assert one(spark, runs.run_outcome(F.lit(True), F.lit("e"), F.lit(1))) == "timeout"
    assert one(spark, runs.run_outcome(F.lit(False), F.lit("e"), F.lit(1))) == "spawn_error"
    assert one(spark, runs.run_outcome(F.lit(False), F.lit(None).cast("string"), F.lit(0))) == "success"


def test_value_rules(spark):
    assert one(spark, exprs.strip(F.col("x")), x="\t a \n") == "a"
    assert one(spark, exprs.first_filled(F.lit(""), F.lit("b"))) == "b"
    assert one(spark, exprs.first_nonzero(F.lit(0.0), F.lit(2.0))) == 2.0
    assert one(spark, exprs.percent_change(F.lit(1.0), F.lit(0.0))) is None


def test_first_k_is_stable_and_bounded(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    found = topk.first_k(rows, ["k"], [F.col("id").desc()], 5)
    assert sorted(r.id for r in found.collect()) == sorted(range(85, 100))
    assert topk.first_k(rows.limit(0), ["k"], ["id"], 5).count() == 0
