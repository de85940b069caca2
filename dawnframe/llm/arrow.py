"""Small helpers for operators that run Python on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows turned into Python objects at once; bounds a worker's memory beside the batch itself.
STEP = 256


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def add_columns(frame: DataFrame, source: str, fields: list[tuple[str, T.DataType, pa.DataType]], make: Callable) -> DataFrame:
    """``frame`` without ``source`` and with new columns computed from it, row by row inside Arrow batches.

    A new column replaces one of the same name.

    ``make()`` is called once in each task and returns ``value -> tuple``, one element for each field.
    """
    made = {n for n, _, _ in fields}
    kept = [f for f in frame.schema.fields if f.name != source and f.name not in made]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t, _ in fields])

    def run(batches):
        one = make()
        for batch in pieces(batches):
            rows = [one(x) for x in batch.column(source).to_pylist()]
            columns = {f.name: batch.column(f.name) for f in kept}
            for i, (name, _, kind) in enumerate(fields):
                columns[name] = pa.array([r[i] for r in rows], kind)
            yield pa.RecordBatch.from_pydict(columns)

    return frame.mapInArrow(run, schema)
