"""Language identification by nearest centroid.

A text is lower-cased, runs of anything but letters and their combining marks become one space, and its character 1-, 2- and 3-grams are counted in
``DIMENSIONS`` hashed buckets; the vector is root term frequency times inverse document frequency, normalised.  Each
language has up to ``CENTROIDS`` centroids by spherical k-means; a text takes the language of the centroid with
the highest cosine.  It is rejected if that cosine is under ``SLACK`` times the ``LOW`` quantile of the training
texts of that language and about its length, which leaves unusual but real text alone.  Lengths count by powers of two;
a class with fewer than ``ENOUGH`` training texts takes in its nearest ones.  Below the shortest training text the bound
falls as the root of the length, as the cosine of so few n-grams does; above the longest it stays.  Texts alone in their
cluster don't count, as their cosine is 1 whatever they hold; a language with no others takes the least bound of the rest.

Training takes at most ``PER_LANGUAGE`` labelled documents of each of the ``LANGUAGES`` most frequent languages (those with the
least hash of their id, so the choice doesn't depend on the partitioning); whole texts of these are read.  These two numbers bound
what the driver holds and broadcasts.  Prediction covers every row and
whole texts.  Each language is clustered in a task of its own, over a bounded number of vectors of fixed length.

Defined results: a null text, or one without a letter (Unicode category L; number forms such as ½ or Ⅷ are none), is ``und``
with score 0 and rejected; without any labelled document everything is; an empty table gives an empty table; ties go to the language that sorts first; repeated rows are predicted one by one; columns
other than those named pass through or are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnframe.durable import written
from dawnframe.llm.arrow import add_columns, pieces
from dawnframe.llm.sampling import least_hashed

DIMENSIONS = 4096
CENTROIDS = 3
PER_LANGUAGE = 800
LANGUAGES = 1000
SLACK, LOW, ENOUGH = 0.55, 0.01, 50
#: Classes of length: bit lengths of the number of n-grams.
CLASSES = 64
ROUNDS = 8
UNKNOWN = "und"
FOLDS = 5
#: Characters turned into n-grams at once; bounds the memory of a very long text.
BLOCK = 1 << 18


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for combining marks, 0 for the rest."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8)


def _plain(text: str) -> np.ndarray | None:
    """Code points in lower case with one space for each run of what isn't a word, or None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kinds = _kinds()[codes]
    if not (kinds == 2).any():
        return None
    inside = kinds > 0
    start = ~inside
    start[1:] &= inside[:-1]  # the first of each run of non-words stands for it
    codes = np.where(inside, codes, np.uint32(32))[inside | start]
    return np.pad(codes, (int(codes[0] != 32), int(codes[-1] != 32)), constant_values=32)


def held_out() -> Column:
    """True for the documents that no training may use."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams, or None without a letter."""
    if not text:
        return None
    codes = _plain(text)
    if codes is None:
        return None
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(codes) - 2, BLOCK):
        c = codes[at : at + BLOCK + 2].astype(np.uint64)
        one, two = c[1:-1], c[:-1] * np.uint64(0x1F123BB5) + c[1:]
        three = two[:-1] * np.uint64(0x5BD1E995) + c[2:]
        for salt, grams in ((1, one), (2, two[:-1]), (3, three)):
            mixed = (grams + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
    return counts


def _normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def _cluster(unit: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same for the same rows in the same order."""
    centres = [_normalised(unit.mean(0))]
    while len(centres) < min(k, len(unit)):
        centres.append(unit[int(np.argmin((unit @ np.array(centres).T).max(1)))])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(1)
        centres = np.array([_normalised(unit[own == i].sum(0)) if (own == i).any() else c for i, c in enumerate(centres)])
    return centres


def _floors(cosines: np.ndarray, sizes: np.ndarray) -> list[float]:
    """The least accepted cosine of each class of length, from training texts' cosines and classes."""
    floors = []
    for size in range(CLASSES if len(sizes) else 0):
        apart = np.abs(sizes - size)
        near = apart <= np.sort(apart)[min(ENOUGH, len(apart)) - 1]
        floors.append(SLACK * float(np.quantile(cosines[near], LOW)) * 2.0 ** (min(size - int(sizes.min()), 0) / 2))
    return floors


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, text, lang): at most so many labelled documents of each language outside the held-out fold."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = labelled.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    frequent = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    ids = ids.join(F.broadcast(frequent), "lang")
    chosen = least_hashed(ids, "doc_id", per_language, by="lang")
    texts = labelled.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen: per_language ids of each language
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("lang").alias("lang"))


def _vectors(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            made = [(i, g, c) for i, g, t in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "lang", "text")), strict=True) if (c := ngram_counts(t)) is not None]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([m[0] for m in made], pa.int64()), "lang": pa.array([m[1] for m in made], pa.string()), "counts": pa.array([m[2].astype(np.int32) for m in made], pa.list_(pa.int32()))})

    return rows.mapInArrow(run, "doc_id long, lang string, counts array<int>")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model: languages, centroids, idf and the least accepted cosines by language and length class; a few hundred KB."""
    vectors = written(_vectors(sample(docs.select("doc_id", "text", "lang"), per_language)), "langid-sample")

    def seen(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(rows)], "df": [(np.stack(rows.counts) > 0).sum(0).tolist()]})

    by_language = vectors.groupBy("lang").applyInPandas(seen, "n long, df array<long>").collect()  # a row for each language
    total = sum(r.n for r in by_language)
    frequency = np.sum([r.df for r in by_language], axis=0) if by_language else np.zeros(DIMENSIONS)
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def cluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.stack(rows.sort_values("doc_id").counts)
        unit = _normalised(np.sqrt(counts) * idf)
        centres = _cluster(unit, CENTROIDS)
        cosines, size = unit @ centres.T, np.array([int(n).bit_length() for n in counts.sum(1)])
        own = cosines.argmax(1)
        shared = np.bincount(own)[own] > 1
        least = _floors(cosines.max(1)[shared], size[shared])
        return pd.DataFrame({"lang": [key[0]] * len(centres), "centre": [c.tolist() for c in centres], "least": [least] * len(centres)})

    rows = vectors.groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>, least array<double>").collect()  # a few rows for each language
    rows.sort(key=lambda r: (r.lang, r.centre))
    known = [r.least for r in rows if r.least]
    others = np.min(known, axis=0).tolist() if known else [0.0] * CLASSES
    least = [r.least or others for r in rows]
    centres = np.array([r.centre for r in rows], np.float32).reshape(-1, DIMENSIONS)
    return {"langs": [r.lang for r in rows], "centres": centres.T.copy(), "idf": idf.astype(np.float32), "least": least}


def _predictor(model: dict):
    def one(text):
        counts = ngram_counts(text) if model["langs"] else None
        if counts is None:
            return UNKNOWN, 0.0, True
        cosines = _normalised(np.sqrt(counts) * model["idf"]) @ model["centres"]
        best = int(cosines.argmax())
        cosine = float(min(max(cosines[best], 0.0), 1.0))
        return model["langs"][best], cosine, cosine < model["least"][best][int(counts.sum()).bit_length()]

    return one


FIELDS = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("rejected", T.BooleanType(), pa.bool_())]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (the cosine), ``rejected`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return add_columns(rows, "text", FIELDS, lambda: _predictor(shared.value))


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that are not rejected, with the columns of ``docs``; a null or blank ``lang`` becomes the predicted one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    named = [i for i, f in enumerate(schema.fields) if f.name == "lang" and isinstance(f.dataType, T.StringType)]

    def run(batches):
        one = _predictor(shared.value)
        for batch in pieces(batches):
            found = [one(t) for t in batch.column("text").to_pylist()]
            for i in named:
                langs = [g if g and g.strip() else f[0] for g, f in zip(batch.column(i).to_pylist(), found, strict=True)]
                batch = batch.set_column(i, batch.schema.field(i), pa.array(langs, batch.schema.field(i).type))
            yield batch.filter(pa.array([not f[2] for f in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
