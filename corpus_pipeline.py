"""From raw documents to a training mixture: five stages, each one operator over all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again before the
next.  All but the last return the columns of ``documents``.

Defined results: a null or empty text is near no language and goes in the first stage; of repeated rows and equal texts with ids one row stays, that of the least
id; further columns, whatever their names, pass through, but for ``topic`` and ``probability``, which the last stage sets; an empty table gives an
empty table; whole texts of any length are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dawnframe.durable import discard_since, mark, written
from dawnframe.llm import decontaminate, langid, mixing, secrets, simhash
from dawnframe.shipping import ship
from dawnframe.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near no language's centroids go (no letters, or far from all training texts); a missing ``lang`` is filled in."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id."""
    return simhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return secrets.redact(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing_weights", mixing_weights),
]

#: Hashing, centroids and raking aren't SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_since(spark, start)  # the stage before, and what the operators wrote on the way
    return docs
