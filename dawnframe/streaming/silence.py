"""Silence alarms: a row when a key falls silent and one when it returns.

State with event-time timers.  A key's beats are kept as sessions (first beat, last beat, number), runs without a gap over
the limit; a hot key's beats are merged chunk by chunk, so the state grows with the number of silences that are still
open and not with beats.  A session is settled once the watermark passes its last beat plus the limit: later beats can't
join it any more.  A return is settled once the watermark passes its first beat.  So results don't depend on how beats fall
into micro-batches, nor on restarts, but for what is late.

Keys are dealt to ``GROUPS`` groups by hash, and a group's keys share a state and a timer: Spark starts the function once for each
group that has beats or a timer due, not for each key, and a group's beats are merged for all its keys at once.  To move on a key that
has nothing due changes nothing.

A beat at or before the watermark that its batch began with is late and changes nothing.  A key that stays
silent for ``forget`` loses its state; if it comes back after that, it begins anew and no return is reported.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECOND = 1_000_000
#: No instant or number; watermarks begin at 1970, so no beat that counts has it.
NONE = -1
#: Fixed value: it is part of a checkpoint.
GROUPS = 1024
#: The group's keys; their sessions as (place of the key, first, last, number); for each key whether its first session's return is told, and the last beat before that.
STATE = "keys string, sessions binary, marks binary"
NULL_KEY = ""


def _merged(sessions: np.ndarray, limit: int) -> np.ndarray:
    """Sessions (key, first, last, number), in any order, with those of a key that lie no more than the limit apart made one; by key and first beat."""
    if not len(sessions):
        return sessions
    key, first, last, number = sessions[np.lexsort((sessions[:, 1], sessions[:, 0]))].T
    reached = pd.Series(last).groupby(key).cummax().to_numpy()
    cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (first[1:] - reached[:-1] > limit)) + 1])
    return np.stack([key[cut], first[cut], np.maximum.reduceat(last, cut), np.add.reduceat(number, cut)], axis=1)


def _settled(sessions: list, announced: bool, before: int, now: int, limit: int, gone: int):
    """What a key tells at an instant: (rows, open sessions, announced, before, when it is due again or None)."""
    rows, done = [], 0
    for first, last, number in sessions:
        if not announced:
            if before != NONE and first - before <= gone:
                if first > now:
                    return rows, sessions[done:], announced, before, first
                rows.append(("returned", first, before, NONE))
            announced = True
        if last + limit > now:
            return rows, sessions[done:], announced, before, last + limit
        rows.append(("silent", last + limit, last, number))
        announced, before, done = False, last, done + 1
    return rows, [], announced, before, before + gone if before != NONE and before + gone > now else None


def stream_silences(beats: DataFrame, key: str, at: str, limit: int, delay: str, forget: int) -> DataFrame:
    """(key, kind, at, last, n) of a stream of beats; ``limit`` and ``forget`` in seconds, ``delay`` a watermark's.

    ``silent``: at the last beat plus the limit, with the last beat and the beats of the session; ``returned``: at the first
    beat after a silence, with the last one before it.  Beats without an instant are ignored; a null key is a key, and keys are of a type that
    its text can be cast back to.  Append mode.
    """
    most, gone = limit * SECOND, forget * SECOND
    kind = beats.schema[key].dataType
    schema = "_key string, kind string, at long, last long, n long"

    def watch(name, frames, state: GroupState):
        now = state.getCurrentWatermarkMs() * 1000
        known, packed, told = state.get if state.exists else ("[]", b"", b"")
        keys = json.loads(known)
        sessions, marks = np.frombuffer(packed, np.int64).reshape(-1, 4), np.frombuffer(told, np.int64).reshape(-1, 2).tolist()
        place = {k: i for i, k in enumerate(keys)}
        for frame in frames:
            frame = frame[frame["_us"] > now]
            codes, names = pd.factorize(frame["_key"])
            places = np.array([place.setdefault(k, len(place)) for k in names], np.int64)
            us = frame["_us"].to_numpy(np.int64)
            sessions = _merged(np.concatenate([sessions, np.stack([places[codes], us, us, np.ones_like(us)], axis=1)]), most)
        keys, marks = list(place), marks + [[False, NONE]] * (len(place) - len(marks))
        ends = np.searchsorted(sessions[:, 0], np.arange(len(keys) + 1))
        spans = sessions[:, 1:].tolist()
        rows, left, dues = [], [], []
        for i, (k, (announced, before)) in enumerate(zip(keys, marks, strict=True)):
            found, opened, announced, before, due = _settled(spans[ends[i] : ends[i + 1]], bool(announced), before, now, most, gone)
            rows += [(k, *row) for row in found]
            if due is not None:
                dues.append(due)
                left.append((k, opened, announced, before))
        if left:
            kept = np.array([(i, *s) for i, (_, opened, _, _) in enumerate(left) for s in opened], np.int64)
            state.update((json.dumps([k for k, *_ in left]), kept.tobytes(), np.array([x[2:] for x in left], np.int64).tobytes()))
            state.setTimeoutTimestamp(min(dues) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["_key", "kind", "at", "last", "n"]).astype({"_key": object, "kind": object, "at": "int64", "last": "int64", "n": "int64"})

    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(NULL_KEY))
    dated = beats.where(F.col(at).isNotNull()).withWatermark(at, delay).select(name.alias("_key"), at, F.unix_micros(at).alias("_us"))
    grouped = dated.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(GROUPS)).cast("int")).groupBy("_group")
    found = grouped.applyInPandasWithState(watch, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    known = lambda c: F.nullif(F.col(c), F.lit(NONE))
    back = F.when(F.col("_key") != NULL_KEY, F.substring("_key", 2, 2**31 - 1)).cast(kind)
    return found.select(back.alias(key), "kind", F.timestamp_micros(known("at")).alias("at"), F.timestamp_micros(known("last")).alias("last"), known("n").alias("n"))
