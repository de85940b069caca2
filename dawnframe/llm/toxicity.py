"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or absent: words, their first five and seven bytes as stems (inflected forms share them),
word pairs, and pairs with one word skipped, hashed into ``BUCKETS``.  FTRL-proximal learns with per-coordinate
rates; its L1 term leaves most weights at exactly zero, so the weights that remain are a small table that is bounded
by ``BUCKETS`` and can be broadcast.

Training takes at most ``FIT_ROWS`` labelled documents (those with the least hash of their id).  They are dealt to
shards of about ``SHARD_ROWS``; each shard learns on its own and the weights are averaged (parameter mixing).
Scoring covers every row and whole texts.

Defined results: a text without a known word (null and empty ones too) scores the training share of toxic
texts; without any label every score is 0; several labels of one document count as their highest; repeated rows are scored one
by one; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnframe.llm.arrow import add_columns, pieces
from dawnframe.llm.langid import FOLDS, held_out
from dawnframe.llm.sampling import least_hashed

BUCKETS = 1 << 20
OFFSET = -1
FIT_ROWS = 20000
SHARD_ROWS = 5000
#: A bucket that fewer training texts of a shard have is left out.
LEAST_TEXTS = 3
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 12.0, 0.1
#: Toxic texts are rare: each counts as so many.
TOXIC_WEIGHT = 4
#: Bytes turned into features at once; bounds the memory of a very long text.
BLOCK = 1 << 17

_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(keys: np.ndarray, salt: int) -> np.ndarray:
    return ((keys * np.uint64(2 * salt + 1) + np.uint64(salt)) * _MIX) >> _SHIFT


_SIGNS = re.compile(r"[^\w\s]")
_IN_WORD = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])
#: A value for each byte at each place of a word; a word's key is the sum of its bytes' values.
_PLACES = 32
_VALUES = (np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _MIX) ^ ((np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(29))
STEM_BYTES = (5, 7)


def _keys(data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the words in UTF-8 bytes: their keys, the keys of their stems, and where they start."""
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), [], starts
    index = np.arange(len(data))
    place = index - np.maximum.accumulate(np.where(first, index, 0))
    values = _VALUES[np.minimum(place, _PLACES - 1) * 256 + data]
    values[~inside] = 0
    return np.add.reduceat(values, starts), [np.add.reduceat(np.where(place < n, values, 0), starts) for n in STEM_BYTES], starts


def buckets(text: str | None) -> np.ndarray:
    """The buckets of a text, with repeats."""
    plain = (text or "").lower()
    data = np.frombuffer((plain if plain.isascii() else _SIGNS.sub(" ", plain)).encode("utf-8", "replace"), np.uint8)
    found, at = [], 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):  # up to a gap between words; a word longer than the block is cut
            gaps = np.flatnonzero(~_IN_WORD[data[at:end]])
            end = at + int(gaps[-1]) if len(gaps) and gaps[-1] else end
        keys, stems, starts = _keys(data[at:end])
        pairs = keys[:-1] * np.uint64(0x1000193) + keys[1:]
        skips = keys[:-2] * np.uint64(0x1000193) + keys[2:]
        found += [_bucket(k, i) for i, k in enumerate((keys, *stems, pairs, skips), 1)]
        back = at + int(starts[-2]) if len(starts) > 2 else end  # the last two words again, for pairs across the cut
        at = end if end >= len(data) else max(back, at + 1)
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text, sorted."""
    return np.unique(buckets(text)).astype(np.int32)


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, text): at most ``rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.lit(0).alias("all"))
    chosen = least_hashed(ids, "doc_id", rows, by="all").select("doc_id", "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen: at most ``rows`` pairs of numbers
    return texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            made = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic").cast(pa.int32()), "features": pa.array(made, pa.list_(pa.int32()))})

    return rows.mapInArrow(run, "doc_id long, toxic int, features array<int>")


def ftrl(offset: float, labels: np.ndarray, cuts: np.ndarray, found: np.ndarray) -> dict[int, float]:
    """Non-zero weights after ``EPOCHS`` passes over texts whose buckets lie between the cuts."""
    common = np.bincount(found, minlength=BUCKETS) >= LEAST_TEXTS
    used, stays = np.flatnonzero(common), common[found]
    cuts = np.concatenate([[0], np.cumsum(stays)])[cuts]
    at = np.searchsorted(used, found[stays])
    z, n = np.zeros(len(used)), np.zeros(len(used))

    def weights(i):
        return np.where(np.abs(z[i]) > L1, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for r, label in enumerate(labels.tolist()):
            i = at[cuts[r] : cuts[r + 1]]
            w = weights(i)
            gradient = (_share(offset + w.sum()) - label) * (TOXIC_WEIGHT if label else 1)
            rate = (np.sqrt(n[i] + gradient * gradient) - np.sqrt(n[i])) / ALPHA
            z[i] += gradient - rate * w
            n[i] += gradient * gradient
    w = weights(np.arange(len(used)))
    return {int(b): float(v) for b, v in zip(used, w, strict=True) if v}


def _share(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict[int, float]:
    """Bucket -> weight, and the log odds of the training share of toxic texts under ``OFFSET``."""
    train = _featured(sample(docs, labels, rows))
    n, toxic = labels.where(~held_out() & F.col("toxic").isNotNull()).agg(F.count("*"), F.sum("toxic")).first()  # one row
    if not n:
        return {}
    offset = math.log(((toxic or 0) + 1) / (n - (toxic or 0) + 1))
    shards = max(1, math.ceil(min(n, rows) / SHARD_ROWS))
    shards += shards % FOLDS == 0  # folds go by the same hash, so that a shard would stay empty

    def learn(part: pa.Table) -> pa.Table:
        mixed = np.array([zlib.crc32(str(d).encode()) for d in part["doc_id"].to_pylist()])
        part = part.take(pa.array(np.argsort(mixed, kind="stable"))).combine_chunks()
        lists = pa.concat_arrays(part["features"].chunks) if part.num_rows else pa.array([], pa.list_(pa.int32()))
        found = ftrl(offset, part["toxic"].to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy())
        return pa.table({"bucket": pa.array(list(found.keys()), pa.int64()), "weight": pa.array(list(found.values()), pa.float64())})

    shard = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(shards))
    learnt = train.groupBy(shard.alias("shard")).applyInArrow(learn, "bucket long, weight double")
    mixed = learnt.groupBy("bucket").agg((F.sum("weight") / shards).alias("weight"))
    return {OFFSET: offset} | {r.bucket: r.weight for r in mixed.collect()}  # at most BUCKETS rows, in fact a few thousand


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        dense = np.zeros(BUCKETS, np.float32)
        for bucket, weight in shared.value.items():
            if bucket >= 0:
                dense[bucket] = weight
        offset = shared.value.get(OFFSET, 0.0)

        def one(text):
            found = buckets(text)
            p = _share(offset + float(dense[np.unique(found[dense[found] != 0])].sum(dtype=np.float64))) if shared.value else 0.0
            return p, int(p >= 0.5)

        return one

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return add_columns(rows, "text", [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())], make)
