"""Run observation: latest status, outcomes, stalls, marker lines and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("ok", "degraded", "failed")


def latest_status(beats: DataFrame, keys: list[str], at: str, started: str, fields: list[str]) -> DataFrame:
    """The last heartbeat of each key with its fields and the seconds since the first start.  Works on a stream too."""
    last = F.max(F.struct(at, *fields)).alias("_last")
    agg = beats.groupBy(*keys).agg(last, F.min(started).alias("_first"))
    elapsed = F.unix_micros(F.col(f"_last.{at}")) - F.unix_micros("_first")
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (at, *fields)], (elapsed / 1e6).alias("elapsed_sec"))


def run_outcome(timed_out: Column, spawn_error: Column, code: Column) -> Column:
    """timeout, then spawn error, then exit code, in this order."""
    return F.when(timed_out, "timeout").when(spawn_error.isNotNull(), "spawn_error").when(code != 0, "nonzero_exit").when(code == 0, "success").otherwise("running")


def stalled_runs(status: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Runs whose last heartbeat is older than so many seconds."""
    silent = (F.unix_micros(now) - F.unix_micros(F.col(at))) / 1e6
    return status.withColumn("silent_sec", silent).where(F.col("silent_sec") > seconds)


def parse_markers(rows: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """Marker lines as (kind, value); and those whose status is none of the known ones."""
    status = F.regexp_extract(line, r"^\[skill-status:([^\]]*)\]$", 1)
    trace = F.regexp_extract(line, r"^\[trace:([^\]]+)\]$", 1)
    kind = F.when(status != "", "status").when(trace != "", "trace")
    found = rows.withColumns({"kind": kind, "value": F.when(status != "", status).otherwise(trace)}).where(F.col("kind").isNotNull())
    bad = (F.col("kind") == "status") & ~F.col("value").isin(*STATUSES)
    return found.where(~bad), found.where(bad)


def status_rollup(rows: DataFrame, job: str, day: Column, status: str) -> DataFrame:
    """Counts of each known status by job and day.  The list of statuses is fixed, so the pivot reads the data once."""
    counts = rows.groupBy(job, day.alias("day")).pivot(status, list(STATUSES)).agg(F.count(F.lit(1)))
    return counts.fillna(0, list(STATUSES))
