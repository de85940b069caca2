"""Properties over random frames: upserts, newest-k, keep-first, transitions and the log round trip."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dawnframe.operators import keyed, news, series, topk
from dawnframe.sources import logs
from dawnframe.streaming import polls

SCHEMA = "symbol string, date date, close double, batch_seq int"


def random_rows(rng, n):
    return [(rng.choice("ABCD"), dt.date(2026, 1, 1) + dt.timedelta(days=rng.randrange(40)), float(rng.randrange(1000)), i) for i in range(n)]


def table(frame):
    return sorted((r.symbol, r.date, r.close) for r in frame.collect())


@pytest.mark.parametrize("seed", range(3))
def test_upsert_equals_a_dict(spark, seed):
    rng = random.Random(seed)
    first, second = random_rows(rng, 150), random_rows(rng, 60)
    want = {(s, d): c for s, d, c, _ in first} | {(s, d): c for s, d, c, _ in second}
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    empty = frame([]).drop("batch_seq")
    once = series.upsert_series(series.upsert_series(empty, frame(first)), frame(second))
    assert table(once) == sorted((*k, v) for k, v in want.items())
    assert table(series.upsert_series(once, frame(second))) == table(once)


@pytest.mark.parametrize("seed", range(2))
def test_window_holds_the_newest_rows_in_order(spark, seed):
    rng = random.Random(seed)
    rows = {(s, d): c for s, d, c, _ in random_rows(rng, 120)}
    frame = spark.createDataFrame([(*k, v) for k, v in rows.items()], "symbol string, date date, close double")
    found = series.window_last_n(frame, 7).collect()
    for symbol in "ABCD":
        days = sorted(d for s, d in rows if s == symbol)[-7:]
        got = sorted((r.position, r.date) for r in found if r.symbol == symbol)
        assert got == list(enumerate(days))


def test_dedup_keeps_the_first_of_each_title(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), rng.randrange(3), i, rng.choice(["News", "news", "NEWS", "Other", "other", "Ünï"])) for i in range(80)]
    frame = spark.createDataFrame(rows, "id int, section string, feed_order int, position int, title string")
    kept = {r.id for r in news.dedup_titles(frame, "section", "title", ["feed_order", "position"], "id").collect()}
    first = {}
    for i, section, feed, position, title in sorted(rows, key=lambda r: (r[2], r[3])):
        first.setdefault((section, title.lower()), i)
    assert kept == set(first.values())


def test_keep_first_breaks_ties_by_order(spark):
    frame = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 1)], "id int, k string, v int")
    assert sorted(r.id for r in topk.keep_first(frame, ["k"], ["v", "id"]).collect()) == [1, 3]


def test_guarded_write_applies_or_skips_each_write_once(spark):
    base = spark.createDataFrame([(i, "old", i % 5) for i in range(40)], "id int, status string, version int")
    writes = spark.createDataFrame([(i, "new", (i % 5) + (i % 2)) for i in range(0, 50, 2)] + [(1, "new", 9)], "id int, status string, version int")
    applied, skipped = keyed.guarded_write(base, writes, "id", "version", ["status"])
    assert {r.id for r in applied.where("status = 'new'").collect()} == set(range(0, 40, 2))
    assert {r.id for r in skipped.collect()} == {1, 40, 42, 44, 46, 48}


def test_log_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [(dt.datetime(2026, 1, 1, 8, i), f"S{i} x", rng.randrange(10000) / 100, rng.randrange(10000) / 100, dt.date(2026, 1, 2), rng.randrange(10000) / 100, dt.date(2026, 1, 3)) for i in range(20)]
    frame = spark.createDataFrame(rows, "at timestamp, symbol string, close double, high double, high_day date, low double, low_day date")
    path = str(tmp_path / "log")
    for part in (frame.where("symbol < 'S2'"), frame.where("symbol >= 'S2'")):
        logs.append_log(part.select(logs.snapshot_line(*[F.col(c) for c in ("at", "symbol", "close", "high", "high_day", "low", "low_day")]).alias("value")), path)
    logs.append_log(spark.createDataFrame([("not a snapshot",)], "value string"), path)
    assert sorted(map(tuple, logs.parse_log(spark.read.text(path)).collect())) == sorted(map(tuple, frame.collect()))


def _polled(spark, tmp_path, rows, polls_of):
    frame = spark.createDataFrame(rows, "symbol string, date int, close double, seq int")
    source = str(tmp_path / "in")
    for part in range(3):
        frame.where(polls_of == part).coalesce(1).write.mode("append").parquet(source)
    return frame.schema, spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)


@pytest.mark.parametrize("ratio", [0.0, 1.0, 1e9])
def test_streamed_upsert_equals_the_batch_form(spark, tmp_path, ratio):
    rng = random.Random(6)
    rows = [(rng.choice("AB"), rng.randrange(5) or None, float(i), i) for i in range(60)]
    schema, stream = _polled(spark, tmp_path, rows, F.col("seq") % 3)
    path = str(tmp_path / "series")
    polls.stream_upsert_series(stream.where("date is not null"), path, str(tmp_path / "offsets"), ratio=ratio).awaitTermination()
    found = polls.read_series(spark, path, schema).collect()
    want = {(s, d): c for s, d, c, _ in rows if d is not None}
    assert {(r.symbol, r.date): r.close for r in found} == want and len(found) == len(want)
