"""An ordered fold of state changes: each key's requests, one after the other, against a machine of few states.

Every request asks for a state; whether it is granted depends on the state that the requests before it left.  A
request is thus a function on states, and functions compose: requests are dealt to ranges of (key, order), each range streams
through its own once and notes, for every state its part of a key could begin in, the state before each request.  From
one row for each (key, range) the true state at each range's begin follows, and is joined back.  So a key may hold any
share of all requests, and nothing of a key is collected but a short array for each range.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnframe.durable import written


def fold(rows: DataFrame, requests: DataFrame, key: str, order: list[str], allowed: list[tuple[str, str]], state: str = "status", wanted: str = "new_status") -> tuple[DataFrame, DataFrame]:
    """(rows after all requests, requests with ``before``, ``granted`` and ``after``).

    ``allowed`` lists the moves (from, to).  A request that isn't allowed in the state it meets changes nothing; so does one of an unknown
    key (``before`` is null) or for no state.  Rows in a state that no move leaves stay.  ``rows`` has unique keys; ``order`` tells a key's requests apart.
    """
    states = sorted({s for move in allowed for s in move})
    step = {s: [states.index(s) if (a, s) in set(allowed) else i for i, a in enumerate(states)] for s in states}
    same = list(range(len(states)))
    names = requests.columns
    schema = T.StructType([*requests.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_nth", T.LongType()), T.StructField("_ways", T.ArrayType(T.IntegerType()))])

    def run(batches):
        part, at, ways, nth = TaskContext.get().partitionId(), ..., same, 0
        for batch in batches:
            out = []
            for k, to in zip(batch.column(key).to_pylist(), batch.column(wanted).to_pylist(), strict=True):
                if at is ... or k != at:
                    at, ways, nth = k, same, 0
                out.append((nth, ways))
                moved = step.get(to, same)
                ways, nth = [moved[w] for w in ways], nth + 1
            columns = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(columns | {"_part": pa.array([part] * len(out), pa.int32()), "_nth": pa.array([n for n, _ in out], pa.int64()), "_ways": pa.array([w for _, w in out], pa.list_(pa.int32()))})

    ranges = [F.col(c).asc_nulls_first() for c in (key, *order)]
    noted = written(requests.repartitionByRange(*ranges).sortWithinPartitions(*ranges).mapInArrow(run, schema), "requests")

    number = F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*map(F.lit, same)))
    steps = F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*[F.array(*map(F.lit, step[s])) for s in states]))
    through = F.transform(F.col("_last._ways"), lambda w: F.coalesce(F.element_at(F.element_at(steps, F.col("_last._to")), w + 1), w))
    parts = noted.groupBy(key, "_part").agg(F.max(F.struct("_nth", "_ways", F.col(wanted).alias("_to"))).alias("_last")).select(key, "_part", through.alias("_through"))
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "_through"))).alias("_parts"))  # a row for each range at most

    now = rows.select(F.col(key).alias("_key"), F.col(state).alias("_state"), F.try_element_at(number, F.col(state)).alias("_begin"))
    walk = lambda acc, p: F.struct(F.concat(acc.begins, F.array(F.struct(p["_part"].alias("_part"), acc.now.alias("_begin")))).alias("begins"), F.element_at(p["_through"], acc.now + 1).alias("now"))
    none = F.array().cast("array<struct<_part:int,_begin:int>>")
    walked = F.aggregate("_parts", F.struct(none.alias("begins"), F.col("_begin").alias("now")), walk)
    known = listed.join(now, F.col(key).eqNullSafe(F.col("_key"))).select("_key", "_state", walked.alias("_walked"))

    begins = known.select("_key", "_state", F.explode("_walked.begins").alias("_b")).select("_key", "_state", F.col("_b._part").alias("_at"), F.col("_b._begin").alias("_begin"))
    met = noted.join(begins, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    literal = F.array(*map(F.lit, states))
    before = F.coalesce(F.get(literal, F.get("_ways", F.col("_begin"))), F.col("_state"))
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(allowed)])
    told = met.withColumn("before", before).withColumn("granted", F.coalesce(F.array_contains(moves, F.struct(F.col("before").alias("a"), F.col(wanted).alias("b"))), F.lit(False)))
    told = told.select(*names, "before", "granted", F.when(F.col("granted"), F.col(wanted)).otherwise(F.col("before")).alias("after"))

    ended = known.select(F.col("_key"), F.get(literal, F.col("_walked.now")).alias("_end"))
    after = rows.join(ended, F.col(key).eqNullSafe(F.col("_key")), "left").select(*[F.coalesce("_end", state).alias(state) if c == state else F.col(c) for c in rows.columns])
    return after, told
