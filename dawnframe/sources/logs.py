"""Text logs, JSON dumps and checked record loads."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLUG = r"^[a-z][a-z0-9-]*$"
#: JSON names every column in every row, so it packs well; a gzipped file is read by one task, so its rows are bounded.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 250_000}


def table_dump(rows: DataFrame, path: str, packed: bool = False) -> None:
    """A whole table as JSON lines; ``packed``: gzipped."""
    rows.write.mode("errorifexists").options(**(PACKED if packed else {})).json(path)


def restore(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Instants with all their digits; the default format drops what is below a millisecond.
INSTANTS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _facts(name: str, rows: DataFrame) -> DataFrame:
    """A table's entry in a manifest: its columns, rows, and a digest of them without regard to order."""
    digest = F.sum(F.xxhash64(F.to_json(F.struct(*rows.columns), INSTANTS)).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("n"), digest.alias("digest")).select(F.lit(name).alias("table"), F.lit(rows.schema.json()).alias("columns"), "n", "digest")


def dump_all(tables: dict[str, DataFrame], path: str, packed: bool = False) -> None:
    """Every table as JSON lines (``packed``: gzipped), and then the manifest: a dump without one is unfinished."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").options(**(PACKED if packed else {}), **INSTANTS).json(f"{path}/tables/{name}")
    reduce(DataFrame.unionByName, [_facts(n, t) for n, t in tables.items()]).write.json(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table string, columns string, n long, digest string").json(f"{path}/manifest")


def restore_all(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump with the columns that its manifest says."""
    entries = _manifest(spark, path).collect()  # a row for each table
    return {e.table: spark.read.schema(T.StructType.fromJson(json.loads(e.columns))).options(**INSTANTS).json(f"{path}/tables/{e.table}") for e in entries}


def verify_dump(spark: SparkSession, path: str) -> DataFrame:
    """(table, n, intact): whether each table of a dump still has the rows of its manifest."""
    now = reduce(DataFrame.unionByName, [_facts(n, t) for n, t in restore_all(spark, path).items()])
    found = now.select("table", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    intact = F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest"))
    return _manifest(spark, path).join(found, "table", "left").select("table", "n", intact.alias("intact"))


def snapshot_line(at: Column, symbol: Column, close: Column, high: Column, high_day: Column, low: Column, low_day: Column) -> Column:
    """One log line: time, symbol, close, high@day, low@day, two blanks apart."""
    money = lambda x: F.format_string("%.2f", x)
    spot = lambda name, x, day: F.concat(F.lit(f"{name} "), money(x), F.lit("@"), day.cast("string"))
    return F.concat_ws("  ", F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.concat(symbol, F.lit(" close "), money(close)), spot("high", high, high_day), spot("low", low, low_day))


def append_log(lines: DataFrame, path: str) -> None:
    """Append one line for each row; a failed write raises."""
    lines.write.mode("append").text(path)


_LINE = r"^(\S+ \S+)  (.+) close (-?[0-9.]+)  high (-?[0-9.]+)@(\S+)  low (-?[0-9.]+)@(\S+)$"


def parse_log(lines: DataFrame) -> DataFrame:
    """The columns of ``snapshot_line`` back from the text; other lines are left out."""
    part = lambda i: F.regexp_extract("value", _LINE, i)
    rows = lines.where(F.col("value").rlike(_LINE))
    return rows.select(
        part(1).cast("timestamp").alias("at"), part(2).alias("symbol"), part(3).cast("double").alias("close"),
        part(4).cast("double").alias("high"), part(5).cast("date").alias("high_day"), part(6).cast("double").alias("low"), part(7).cast("date").alias("low_day"),
    )


def validate_records(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with all their ``reasons``; a rule is the condition that a row breaks."""
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(reason)) for reason, broken in rules.items()]))
    judged = rows.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def record_rules(source_key: Column, known: list[str]) -> dict[str, Column]:
    """Rules of a registry record (columns ``slug``, ``role`` and ``keys``: the names of its fields)."""
    slug, role, keys = F.col("slug"), F.col("role"), F.col("keys")
    allowed = F.array(*[F.lit(k) for k in known])
    return {
        "forbidden key": F.coalesce(F.array_contains(keys, "secrets"), F.lit(False)),
        "unknown key": F.coalesce(F.size(F.array_except(F.array_remove(keys, "secrets"), allowed)) > 0, F.lit(False)),
        "bad slug": ~F.coalesce(slug.rlike(SLUG), F.lit(False)),
        "slug differs from its source": ~F.coalesce(slug == source_key, F.lit(False)),
        "role is missing": F.coalesce(F.regexp_replace(role, r"\s", ""), F.lit("")) == "",
    }
