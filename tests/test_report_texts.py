"""The daily report, a topic's block, and closes and events that come as rows, on small hand cases."""

from pyspark.sql import functions as F

from dawnframe.operators import news, quotes, registry, signals

ITEM = "report long, section string, position long, title string, link string, section2 string"
FILLER = "- 今日無相關新聞"


def test_daily_report(spark):
    items = [
        (1, "ai", 2, "two", "http://own", ""),
        (1, "ai", 1, "one", None, ""),
        (1, "ai", 3, " padded ", "http://padded", ""),
        (1, "tech", 9, "two", "http://later", ""),  # the last section's link of an equal title wins
        (1, "sport", 1, "one", "http://nowhere", ""),
        (1, "general", 1, None, None, ""),
        *[(1, "general", 10 + i, f"g{i}", "", "") for i in range(5)],
        (1, None, 1, "lost", "http://lost", ""),
        (9, "ai", 1, "no such report", "http://x", ""),
    ]
    reports = spark.createDataFrame([(1, "2026-04-15"), (2, None)], "report long, date string")
    found = {r.report: r.text for r in news.daily_report(reports, spark.createDataFrame(items, ITEM), "report", "date").collect()}
    assert found == {
        1: "📰 早安新聞摘要 — 2026-04-15\n\n**🤖 AI 人工智慧**\n- one\n- two [🔗](http://later)\n-  padded  [🔗](http://padded)\n\n"
        "**💻 科技 & 半導體**\n- two [🔗](http://later)\n\n**🌏 重大新聞**\n- \n- g0\n- g1\n",
        2: f"📰 早安新聞摘要 — \n\n**🤖 AI 人工智慧**\n{FILLER}\n\n**💻 科技 & 半導體**\n{FILLER}\n\n**🌏 重大新聞**\n{FILLER}\n",
    }


def test_daily_report_of_one_hot_report_shuffles_its_first_lines_only(spark):
    items = spark.range(20000).select((1 + F.col("id") % 1).alias("report"), F.when(F.col("id") % 2 < 2, "ai").alias("section"), F.col("id").alias("position"), F.col("id").cast("string").alias("title"), F.lit("").alias("link"))
    reports = spark.createDataFrame([(1, "d")], "report long, date string")
    found = news.daily_report(reports, items, "report", "date")
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().text.split("\n")[3:14] == [*[f"- {i}" for i in range(10)], ""]
    assert news.daily_report(reports.limit(0), items, "report", "date").collect() == []


def test_topic_block(spark):
    fields = "topic struct<week: int, title_hint: string, angle: string, lens: string, direction: string, key_question: string>"
    topics = [((3, "hint", "angle", "lens", "tech-first", "why?"),), ((3, "hint", None, "lens", "tech-first", ""),), (None,)]
    found = [r[0] for r in spark.createDataFrame(topics, fields).coalesce(1).select(registry.topic_block(F.col("topic"))).collect()]
    head = "=== 本期主題指引（editorial plan） ===\n系列週次：W3\n主題提示：hint\n切入角度（angle）：{}\n觀察視角（lens）：lens\n方向：tech-first\n"
    tail = "\n請以上述主題提示和切入角度為本篇文章的主軸。從素材中選取與此角度相關的新聞，圍繞核心提問展開論述。\n\n"
    assert found == [head.format("angle") + "核心提問：why?\n" + tail, head.format("") + tail, ""]


def test_closes_and_events_as_rows(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, "a"), (1, 2, None, "Market closed"), (1, 3, 3.0, None), (1, 4, 4.0, "b"), (2, 1, None, "Market closed"), (None, 1, 5.0, "c")], "k long, at long, close double, event string")
    assert {r.k: r.closes for r in quotes.newest_closes(rows, ["k"], ["at"], "close").collect()} == {1: [3.0, 4.0], None: [5.0]}
    assert {r.k: r.events for r in signals.first_key_events(rows, ["k"], ["at"], "event").collect()} == {1: ["a", "b"], 2: [], None: ["c"]}
