"""Streams: restarts, late rows, what a poll writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dawnframe.streaming import changes, polls, silence

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
BEAT = "run string, ts timestamp"


def minutes(m):
    return START + dt.timedelta(minutes=m)


def deliver(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def silences(spark, polls_of, path, stops=()):
    """What the alarms say of polls of (run, minute); the stream is ended after some polls and begun again."""
    for i, poll in enumerate(polls_of):
        deliver(spark, f"{path}/in", [(r, minutes(m)) for r, m in poll], BEAT)
        if i in stops or i == len(polls_of) - 1:
            found = silence.stream_silences(source(spark, f"{path}/in", BEAT), "run", "ts", 600, "5 minutes", 7200)
            polls.drained(found, f"{path}/out", f"{path}/offsets")
    at = lambda x: None if x is None else (x.replace(tzinfo=dt.UTC) - START).total_seconds() / 60
    return sorted((r.run, r.kind, at(r["at"]), at(r.last), r.n) for r in spark.read.parquet(f"{path}/out").collect())


POLLS = [
    [("a", 0), ("a", 5), ("b", 1), ("a", 5)],
    [("a", 9), ("b", 30), ("a", 33)],  # b was silent from 1 to 30, a from 9 to 33
    [("a", 4), ("b", 39), ("c", 39)],  # a's beat of minute 4 is late: the watermark stands at 28
    [("c", 40), ("b", 100), ("c", 300)],  # c is gone for more than two hours: it begins anew
]
WANT = sorted([
    ("b", "silent", 11.0, 1.0, 1), ("b", "returned", 30.0, 1.0, None), ("a", "silent", 19.0, 9.0, 4), ("a", "returned", 33.0, 9.0, None),
    ("a", "silent", 43.0, 33.0, 1), ("b", "silent", 49.0, 39.0, 2), ("b", "returned", 100.0, 39.0, None),
    ("b", "silent", 110.0, 100.0, 1), ("c", "silent", 50.0, 40.0, 2),
], key=str)


@pytest.mark.parametrize("stops", [(), (0,), (1, 2)])
def test_silences_survive_restarts(spark, tmp_path, stops):
    assert sorted(silences(spark, POLLS, str(tmp_path), stops), key=str) == WANT


def test_beats_of_one_poll_in_any_order(spark, tmp_path):
    beats = [("a", m) for m in (0, 50, 3, 9, 31, 30, 52, 200)]
    want = [("a", "returned", 30.0, 9.0, None), ("a", "returned", 50.0, 31.0, None), ("a", "silent", 19.0, 9.0, 3), ("a", "silent", 41.0, 31.0, 2), ("a", "silent", 62.0, 52.0, 2)]
    found = silences(spark, [beats, [("z", 400)]], str(tmp_path))
    assert [r for r in found if r[2] < 200] == sorted(want)


def test_a_poll_writes_in_proportion_to_itself(spark, tmp_path):
    schema, path = "symbol string, date int, close double, seq int", str(tmp_path)
    big = [(f"s{i}", i, float(i), 0) for i in range(20000)]
    deliver(spark, f"{path}/in", big, schema)
    for p in range(1, 9):
        deliver(spark, f"{path}/in", [("s1", 1, float(p), p), (f"n{p}", p, 0.0, p)], schema)
    polls.stream_upsert_series(source(spark, f"{path}/in", schema), f"{path}/t", f"{path}/offsets").awaitTermination()
    base, later = changes.current(spark, f"{path}/t")
    assert (base, later) == (0, list(range(1, 9)))
    whole = changes.size(spark, f"{path}/t/base/v=0")
    assert all(changes.size(spark, f"{path}/t/change/v={v}") < whole / 20 for v in later)
    found = {(r.symbol, r.date): r.close for r in polls.read_series(spark, f"{path}/t", schema).collect()}
    assert len(found) == 20008 and found["s1", 1] == 8.0


def test_compaction_and_batches_that_run_again(spark, tmp_path):
    path, merge = str(tmp_path), lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    batch = lambda k, n: spark.createDataFrame([(k, n)], "k string, n long")
    for v in range(4):
        changes.change(batch("a", 1), path, v, merge, ratio=1.5)
        changes.change(batch("a", 1), path, v, merge, ratio=1.5)  # the batch runs again
        assert {r.k: r.n for r in changes.read(spark, path, "k string, n long", merge).collect()} == {"a": v + 1}
    base, later = changes.current(spark, path)
    assert base > 0 and len(changes.versions(spark, f"{path}/base")) <= 2 and all(v > base for v in later)


def test_tally_counts_what_the_windows_leave_out(spark, tmp_path):
    path, schema = str(tmp_path), "job string, ts timestamp, status string"
    day = 24 * 60
    for poll in ([("j", 1), ("j", 2)], [("j", 4 * day)], [("j", 4 * day)], [("j", 3), ("j", 4 * day)], [("j", 9 * day)]):
        deliver(spark, f"{path}/in", [(j, minutes(m), "ok") for j, m in poll], schema)
    rows = source(spark, f"{path}/in", schema)
    polls.tally(rows, f"{path}/all", f"{path}/o1", ["job", F.window("ts", "1 day").alias("window"), "status"]).awaitTermination()
    polls.drained(polls.stream_status_rollup(rows, "job", "ts", "status"), f"{path}/days", f"{path}/o2")
    arrived = polls.read_tally(spark, f"{path}/all", "job string, window struct<start: timestamp, end: timestamp>, status string, n long")
    found = polls.late_rows(arrived, spark.read.parquet(f"{path}/days"), ["job", "window", "status"]).collect()
    assert sorted((r.window.start.day, r.n, r.late) for r in found) == [(1, 2, 1), (5, 3, 0)]


def test_seen_again_after_a_day(spark, tmp_path):
    path, schema, hour = str(tmp_path), "url string, ts timestamp", 60
    for poll in ([("u", 0)], [("u", 5 * hour), ("v", 60 * hour)], [("w", 70 * hour)], [("u", 62 * hour), ("x", 30 * hour), ("w", 71 * hour)]):
        deliver(spark, f"{path}/in", [(u, minutes(m)) for u, m in poll], schema)
    polls.drained(polls.stream_dedup_items(source(spark, f"{path}/in", schema), ["url"], "ts"), f"{path}/out", f"{path}/offsets")
    found = sorted((r.url, (r.ts.replace(tzinfo=dt.UTC) - START).total_seconds() / 3600) for r in spark.read.parquet(f"{path}/out").collect())
    assert found == [("u", 0.0), ("u", 62.0), ("v", 60.0), ("w", 70.0)]  # u comes back after a day, x is late
