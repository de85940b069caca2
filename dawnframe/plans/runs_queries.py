"""Queries of run observation and of the streaming forms.  Streams read files that Spark writes from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dawnframe.durable import shared_folder
from dawnframe.operators import runs, topk
from dawnframe.plans.registry import query
from dawnframe.streaming import polls, silence
from dawnframe.tables import table

POLLS = 8


def _folder(spark, name):
    return f"{shared_folder(spark)}/dawnframe/{name}-{uuid.uuid4().hex}"


def events(spark, sf_dir):
    """``events`` with instants, which watermarks need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _polled(spark, sf_dir, columns, name):
    """``events`` as a stream of files, each a poll of neighbouring events."""
    rows = events(spark, sf_dir).select(*columns)
    path = _folder(spark, name)
    rows.repartitionByRange(POLLS, "event_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)


PERIOD, EVERY_LATE, POLL_FILES = 324_000, 23, 4
#: Eight periods of the month; each event comes with the poll of its period, some with the next.
POLL = f"CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / {PERIOD}) AS INT) + CASE WHEN event_id % {EVERY_LATE} = 0 THEN 1 ELSE 0 END"


def _with_poll(rows):
    period = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / PERIOD).cast("int")
    return rows.withColumn("poll", period + F.when(F.col("event_id") % EVERY_LATE == 0, 1).otherwise(0))


def _delivered(spark, rows, name):
    """Rows with a ``poll`` as a stream in the order of their polls, each poll a micro-batch."""
    path = _folder(spark, name)
    for poll in range(9):
        rows.where(F.col("poll") == poll).drop("poll").repartition(POLL_FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("poll").schema).option("maxFilesPerTrigger", POLL_FILES).parquet(path)


def _marks(delay: int, delivered: str = "SELECT poll, ts FROM p") -> str:
    """SQL: ``p``, events with their poll, ``d``, what is delivered of them, and ``w``, the watermark (milliseconds) that a poll's batch begins with (``e``) and by which it drops rows (``l``: that of the batch before)."""
    return f"""p AS (SELECT *, {POLL} AS poll FROM events), d AS ({delivered}), m AS (SELECT poll, max(epoch_ms(ts)) AS top FROM d GROUP BY 1),
    w AS (SELECT poll, coalesce(max(top) OVER (ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {delay}, 0) AS e, coalesce(max(top) OVER (ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - {delay}, 0) AS l FROM m)"""


@query("o1_stream_upsert_series", "SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, user_id, arg_max(value, event_id) AS close FROM events GROUP BY ALL")
def o1(spark, sf_dir):
    stream = _polled(spark, sf_dir, [F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), "user_id", F.col("value").alias("close"), "event_id"], "polls")
    path, keys = _folder(spark, "series"), ("symbol", "date", "user_id")
    # A file's place in the stream follows no order of events, so the last write is told by the event's number.
    polls.stream_upsert_series(stream, path, _folder(spark, "offsets"), keys, "event_id").awaitTermination()
    found = polls.read_series(spark, path, stream.schema, keys, "event_id")
    return found.select("symbol", F.col("date").cast("string").alias("date"), "user_id", "close")


DAY_MS = 86_400_000


def _deduplicated() -> str:
    """SQL: what is admitted poll by poll; a key of an earlier poll counts until the dropping watermark passes its row by a day."""
    steps, seen = [], []
    for k in range(9):
        live = f" AND NOT EXISTS (FROM ({' UNION ALL '.join(f'FROM a{j}' for j in seen)}) a WHERE a.user_id = d.user_id AND a.event_type = d.event_type AND epoch_us(a.ts) + {DAY_MS}000 > l * 1000)" if seen else ""
        steps.append(f"a{k} AS (SELECT d.* FROM d JOIN w USING (poll) WHERE poll = {k} AND epoch_us(ts) > l * 1000{live})")
        seen.append(k)
    first = "SELECT poll, user_id, event_type, min(ts) AS ts FROM p GROUP BY ALL"
    return f"WITH {_marks(DAY_MS, first)}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT user_id, event_type, CAST(ts AS VARCHAR) AS ts FROM a{k}" for k in range(9))


@query("o2_stream_dedup_items", _deduplicated())
def o2(spark, sf_dir):
    """A poll lists an item once, as a fetched feed does; the stream drops what earlier polls had within a day."""
    items = topk.keep_first(_with_poll(events(spark, sf_dir)).select("poll", "user_id", "event_type", "ts", "event_id"), ["poll", "user_id", "event_type"], ["ts", "event_id"]).drop("event_id")
    path = _folder(spark, "unique-items")
    polls.drained(polls.stream_dedup_items(_delivered(spark, items, "items"), ["user_id", "event_type"], "ts"), path, _folder(spark, "offsets"))
    return spark.read.parquet(path).select("user_id", "event_type", F.col("ts").cast("string").alias("ts"))


LATEST = "SELECT user_id, CAST(max(ts) AS VARCHAR) AS ts, arg_max(event_type, {'t': ts, 'e': event_type}) AS event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS elapsed_sec FROM events GROUP BY user_id"


@query("o3_stream_latest_status", LATEST)
def o3_stream(spark, sf_dir):
    stream = _polled(spark, sf_dir, ["user_id", "ts", "event_type", "event_id"], "beats").withColumn("started_at", F.col("ts"))
    path = _folder(spark, "latest")
    polls.stream_latest_status(stream, path, _folder(spark, "offsets"), ["user_id"], "ts", "started_at", ["event_type"]).awaitTermination()
    found = polls.read_latest_status(spark, path, "user_id long, ts timestamp, event_type string, first_at timestamp", ["user_id"], "ts", ["event_type"])
    return found.select("user_id", F.col("ts").cast("string").alias("ts"), "event_type", F.round("elapsed_sec", 3).alias("elapsed_sec"))


@query("o3_latest_status", LATEST)
def o3(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("started_at", F.col("ts"))
    found = runs.latest_status(rows, ["user_id"], "ts", "started_at", ["event_type"])
    return found.select("user_id", F.col("ts").cast("string").alias("ts"), "event_type", F.round("elapsed_sec", 3).alias("elapsed_sec"))


@query("o4_run_outcome", "SELECT event_id, CASE WHEN value > 15 THEN 'timeout' WHEN event_type = 'error' THEN 'spawn_error' WHEN event_id % 3 = 1 THEN 'nonzero_exit' WHEN event_id % 3 = 0 THEN 'success' ELSE 'running' END AS outcome FROM events")
def o4(spark, sf_dir):
    code = F.when(F.col("event_id") % 3 < 2, F.col("event_id") % 3)
    outcome = runs.run_outcome(F.col("value") > 15, F.when(F.col("event_type") == "error", F.col("props")), code)
    return events(spark, sf_dir).select("event_id", outcome.alias("outcome"))


NOW = "2024-01-30 12:00:00"


@query("o5_stalled_runs", f"SELECT user_id, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 1e6, 3) AS silent_sec FROM events GROUP BY user_id HAVING epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) > 3600000000")
def o5(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("started_at", F.col("ts"))
    status = runs.latest_status(rows, ["user_id"], "ts", "started_at", ["event_type"])
    return runs.stalled_runs(status, "ts", F.lit(NOW).cast("timestamp"), 3600).select("user_id", F.round("silent_sec", 3).alias("silent_sec"))


SILENT, LATE_BEATS, FORGET = 86_400, 21_600, 345_600


@query(
    "o5_stream_silences",
    f"""WITH {_marks(LATE_BEATS * 1000)}, b AS (SELECT user_id, ts, epoch_us(ts) AS us, epoch_us(ts) <= e * 1000 AS late FROM p JOIN w USING (poll)),
    g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM b WHERE NOT late),
    s AS (SELECT *, count(*) FILTER (gap > {SILENT}000000) OVER (PARTITION BY user_id ORDER BY us) AS session FROM g),
    r AS (SELECT user_id, session, min(us) AS first, max(us) AS last, count(*) AS n FROM s GROUP BY ALL),
    q AS (SELECT *, lag(last) OVER (PARTITION BY user_id ORDER BY first) AS before FROM r), z AS (SELECT (max(top) - {LATE_BEATS * 1000}) * 1000 AS now FROM m),
    f AS (SELECT user_id, 'silent' AS kind, last + {SILENT}000000 AS instant, last, n FROM q, z WHERE last + {SILENT}000000 <= now
      UNION ALL SELECT user_id, 'returned', first, before, NULL FROM q, z WHERE first <= now AND first - before <= {FORGET}000000)
    SELECT user_id, kind, CAST(make_timestamp(instant) AS VARCHAR) AS instant, CAST(make_timestamp(last) AS VARCHAR) AS last, n FROM f""",
)
def o5_stream(spark, sf_dir):
    beats = _delivered(spark, _with_poll(events(spark, sf_dir)).select("user_id", "ts", "poll"), "beats")
    path = _folder(spark, "silences")
    polls.drained(silence.stream_silences(beats, "user_id", "ts", SILENT, f"{LATE_BEATS} seconds", FORGET), path, _folder(spark, "offsets"))
    found = spark.read.parquet(path)
    return found.select("user_id", "kind", F.col("at").cast("string").alias("instant"), F.col("last").cast("string").alias("last"), "n")


@query("o6_parse_markers", "SELECT event_id, CASE WHEN event_id % 5 = 3 THEN 'trace' ELSE 'status' END AS kind, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' WHEN 2 THEN 'lost' ELSE 'job-' || user_id END AS value, event_id % 5 <> 2 AS known FROM events WHERE event_id % 5 < 4")
def o6(spark, sf_dir):
    kind = F.col("event_id") % 5
    trace = F.concat(F.lit("[trace:job-"), F.col("user_id").cast("string"), F.lit("]"))
    line = F.when(kind == 0, "[skill-status:ok]").when(kind == 1, "[skill-status:degraded]").when(kind == 2, "[skill-status:lost]").when(kind == 3, trace).otherwise("plain output")
    known, unknown = runs.parse_markers(events(spark, sf_dir).select("event_id", line.alias("line")), "line")
    both = known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))
    return both.select("event_id", "kind", "value", "known")


STATUS = "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'degraded' ELSE 'ok' END"


@query("o7_status_rollup", f"SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER ({STATUS} = 'ok') AS ok, count(*) FILTER ({STATUS} = 'degraded') AS degraded, count(*) FILTER ({STATUS} = 'failed') AS failed FROM events GROUP BY 1, 2")
def o7(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "degraded").otherwise("ok")
    rows = events(spark, sf_dir).withColumn("status", status)
    return runs.status_rollup(rows, "user_id", F.to_date("ts").cast("string"), "status")


@query(
    "o7_stream_status_rollup",
    f"""WITH {_marks(DAY_MS)}, c AS (SELECT event_type, CAST(ts AS DATE) AS day, {STATUS} AS status, epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) + {DAY_MS} AS ends, l FROM p JOIN w USING (poll))
    SELECT event_type, CAST(day AS VARCHAR) AS day, status, count(*) FILTER (ends > l) AS n, count(*) FILTER (ends <= l) AS late FROM c WHERE ends <= (SELECT max(top) - {DAY_MS} FROM m) GROUP BY ALL""",
)
def o7_stream(spark, sf_dir):
    """Days that are over, each written once, and how many rows came after their day was closed."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "degraded").otherwise("ok")
    arriving = _delivered(spark, _with_poll(events(spark, sf_dir)).select("event_type", "ts", "poll"), "status").withColumn("status", status)
    days, every = _folder(spark, "days"), _folder(spark, "arrived")
    running = polls.tally(arriving, every, _folder(spark, "offsets"), ["event_type", F.window("ts", "1 day").alias("window"), "status"])
    counts = polls.stream_status_rollup(arriving, "event_type", "ts", "status")
    polls.drained(counts, days, _folder(spark, "offsets"))
    running.awaitTermination()
    kept = ["event_type", "window", "status"]
    arrived = polls.read_tally(spark, every, "event_type string, window struct<start: timestamp, end: timestamp>, status string, n long")
    found = polls.late_rows(arrived, spark.read.parquet(days), kept)
    return found.select("event_type", F.to_date("window.start").cast("string").alias("day"), "status", "n", "late")
