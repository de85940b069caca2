"""Silence alarms of many keys: the function is started for groups of keys, and keys don't mix within a group."""

import datetime as dt
import json

from pyspark.sql import functions as F

from dawnframe.streaming import silence

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
FAR = 2**60  # beyond what a double tells apart


def test_many_keys_share_states(spark, tmp_path):
    path, many = str(tmp_path), 2500
    polls = [[(FAR + k, m) for k in range(many) for m in (0, k % 9, 60 + k % 3)] + [(None, 5), (None, 61)], [(None, 400)], [(-1, 800)]]
    for rows in polls:
        spark.createDataFrame([(k, START + dt.timedelta(minutes=m)) for k, m in rows], "run long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
    beats = spark.readStream.schema("run long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    found = silence.stream_silences(beats, "run", "ts", 600, "5 minutes", 7200)
    query = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress) if p["stateOperators"]]
    assert 0 < max(held) <= 1024
    minute = lambda c: (F.unix_seconds(c) - int(START.timestamp())) / 60
    got = {(r.run, r.kind, r.at, r.last, r.n) for r in spark.read.parquet(f"{path}/out").select("run", "kind", minute("at").alias("at"), minute("last").alias("last"), "n").collect()}
    want = {(None, "silent", 15, 5, 1), (None, "returned", 61, 5, None), (None, "silent", 71, 61, 1), (None, "silent", 410, 400, 1)}
    for k in range(many):
        last, back = k % 9, 60 + k % 3
        want |= {(FAR + k, "silent", last + 10, last, 2), (FAR + k, "returned", back, last, None), (FAR + k, "silent", back + 10, back, 1)}
    assert got == want
