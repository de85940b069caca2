"""Whitening of embeddings by spectral divide-and-conquer.

Vectors become whole numbers, ``x = floor(256 c)``, so that sums are exact.  The fit list holds each distinct x once: x is
packed into bytes and made distinct by a partial aggregate, so a vector that fills a third of the table is one row before
the shuffle.  Over the fit list Spark adds up the sums S (exact) and then the covariance about the mean, a d x d matrix for
each task and row-wise sums of those.  The d x d covariance alone comes to the driver, where QDWH polar factors of shifted
covariances split it into its leading components (``qdwh``).  The model (mean, components, eigenvalues: a few times d
numbers) is broadcast and every row is projected in Arrow batches.

Bounds: the driver holds a few d x d matrices and refuses more than ``MOST_DIMS`` dimensions; a task holds one d x d matrix and
``STEP`` rows.  Covariances are summed in a fixed number of tasks a core, so partial matrices don't grow with the data.

Defined results: rows whose vector is null or holds a null, NaN or infinity are left out; a shorter vector ends in
zeros (``dims`` is the longest length); an empty vector is all zeros; entries beyond a long's range stay at its ends; repeated
rows are answered one by one and count once in the fit; a component without variance has a null ``whitened`` and counts
in no identity error; ``deviation`` is null where it needs more than 38 digits (in the query: more than a long); no row left: an empty
table; further columns stay, those named as a result are replaced.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnframe.durable import written
from dawnframe.llm import qdwh
from dawnframe.llm.arrow import pieces

SCALE = 256
MOST_DIMS = 8192
TASKS_PER_CORE = 4
LONG = np.iinfo(np.int64)


class Model(NamedTuple):
    """``n`` distinct vectors of ``dims`` entries with per-dimension ``sums``; components as rows, by falling ``values``."""

    n: int
    dims: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """Square roots of the eigenvalues; NaN for a component without variance."""
        floor = len(self.sums) * qdwh.EPS * max(self.trace, 0.0)
        return np.sqrt(np.where(self.values > floor, self.values, np.nan))


def _whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: which rows hold a usable vector, their lengths, and their x one after the other."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(column)), lengths)
    usable = ~column.is_null().to_numpy(zero_copy_only=False)
    usable[row[~np.isfinite(flat)]] = False
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat[usable[row]] * SCALE)
    high, low = scaled >= 2.0**63, scaled < -(2.0**63)
    x = np.where(high | low, 0.0, scaled).astype(np.int64)
    x[high], x[low] = LONG.max, LONG.min
    return usable, lengths[usable], x


def _matrix(lengths: np.ndarray, x: np.ndarray, dims: int) -> np.ndarray:
    if len(lengths) and (lengths == dims).all():
        return x.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = x
    return out


def _packed(x: np.ndarray) -> bytes:
    """One form for each vector: trailing zeros cut, the narrowest whole number that holds all entries, its width first."""
    used = np.flatnonzero(x)
    x = x[: used[-1] + 1] if len(used) else x[:0]
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, packed in enumerate(column.to_pylist()):
        x = np.frombuffer(packed, f"<i{packed[0]}", offset=1)
        out[i, : len(x)] = x
    return out


def fit_list(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each distinct x once: ``x`` packed, and ``dims``, the greatest length it came with."""

    def pack(batches):
        for batch in pieces(batches):
            _, lengths, x = _whole_numbers(batch.column(0))
            ends = np.cumsum(lengths)
            packed = [_packed(x[b - n : b]) for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(packed, pa.binary()), "dims": pa.array(lengths, pa.int32())})

    found = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(pack, "x binary, dims int")
    return found.groupBy("x").agg(F.max("dims").alias("dims"))


def _sums(listed: DataFrame, dims: int) -> tuple[int, ...]:
    """Exact sums of each dimension: high and low halves apart, so that no long overflows."""

    def add(batches):
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in pieces(batches):
            x = _unpacked(batch.column("x"), dims)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(dims), pa.int32()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})

    wide = "decimal(38,0)"
    parts = listed.select("x").mapInArrow(add, "j int, high long, low long").groupBy("j").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    found = {r.j: (int(r.high) << 32) + int(r.low) for r in parts.collect()}  # dims rows
    return tuple(found[j] for j in range(dims))


def _added_products(listed: DataFrame, dims: int, size: int, project) -> np.ndarray:
    """The sum over the fit list of ``y y'`` with ``y = project(x)`` of ``size`` entries."""

    def multiply(batches):
        total = np.zeros((size, size))
        for batch in pieces(batches):
            y = project(_unpacked(batch.column("x"), dims))
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size), pa.int32()), "row": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        rows = np.array([np.frombuffer(r) for r in table.column("row").to_pylist()])
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([rows.sum(axis=0).tobytes()], pa.binary())})

    tasks = TASKS_PER_CORE * listed.sparkSession.sparkContext.defaultParallelism
    parts = listed.select("x").coalesce(tasks).mapInArrow(multiply, "i int, row binary")
    found = {r.i: np.frombuffer(r.row) for r in parts.groupBy("i").applyInArrow(add, "i int, row binary").collect()}  # size rows
    return np.array([found[i] for i in range(size)]).reshape(size, size)


def fit(rows: DataFrame, vector: str = "embedding", components: int | None = None) -> Model:
    """The leading components (all without a number) of the fit list of ``rows``."""
    listed = written(fit_list(rows, vector), "whitening-fit")
    n, dims = listed.agg(F.count("*"), F.max("dims")).first()
    if not n or not dims:
        return Model(n, 0, (), np.empty(0), np.empty((0, 0)), 0.0, None)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MOST_DIMS} are whitened")
    sums = _sums(listed, dims)
    mean = np.array([s / n for s in sums])
    covariance = _added_products(listed, dims, dims, lambda x: x - mean) / n
    values, vectors = qdwh.leading(covariance, components)
    model = Model(n, dims, sums, values, vectors, float(np.trace(covariance)), None)
    real = np.flatnonzero(np.isfinite(model.scales))
    turned, scales = vectors[real], model.scales[real]
    seen = _added_products(listed, dims, len(real), lambda x: (x - mean) @ turned.T / scales) / n if len(real) else np.empty((0, 0))
    return model._replace(identity_error=float(np.abs(seen - np.eye(len(real))).max(initial=0.0)))


def _deviations(x: np.ndarray, model: Model) -> pa.Array:
    most = model.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, model.sums)) if x.size else 0
    if most * most * model.dims <= LONG.max:
        gap = model.n * x - np.array(model.sums, np.int64)
        return pa.array((gap * gap).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    exact = [sum((model.n * a - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x.tolist()]
    return pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))


def whiten(rows: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector of at most the model's length, with ``whitened`` (array, an entry for each component) and ``deviation`` in place of the vector."""
    wide = "_vector"
    source = rows.withColumn(wide, F.col(vector).cast("array<double>")).drop(*{vector, "whitened", "deviation"})
    kept = [f for f in source.schema.fields if f.name != wide]
    schema = T.StructType([*kept, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    if not model.dims:
        return source.where("false").drop(wide).withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("decimal(38,0)")})
    shared = source.sparkSession.sparkContext.broadcast((model, model.mean, model.scales))

    def run(batches):
        m, mean, scales = shared.value
        for batch in pieces(batches):
            usable, lengths, x = _whole_numbers(batch.column(wide))
            if len(lengths) and lengths.max() > m.dims:
                raise ValueError(f"a vector of {lengths.max()} entries; the model has {m.dims}")
            x = _matrix(lengths, x, m.dims)
            white = (x - mean) @ m.components.T / scales
            lists = pa.array([[None if np.isnan(v) else v for v in r] for r in white.tolist()], pa.list_(pa.float64()))
            keep = pa.array(usable)
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name).filter(keep) for f in kept} | {"whitened": lists, "deviation": _deviations(x, m)})

    return source.mapInArrow(run, schema)


def report(rows: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each usable row and component: its whitened coordinate, the share of variance explained and the fit's own check."""
    model = fit(rows, vector, components)
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    facts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(s).cast("double").alias("explained")) for i, s in enumerate(share)])
    facts = facts.cast("array<struct<component:int,explained:double>>")
    each = whiten(rows.select(key, vector), model, vector).select(key, "deviation", F.inline(F.arrays_zip(F.col("whitened").alias("w"), facts.alias("f"))))
    return each.select(
        key, F.col("f.component").alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("w").alias("whitened"), F.col("f.explained").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
