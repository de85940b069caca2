"""Packed dumps are compressed, in files of bounded rows, and come back whole; the queries pack theirs."""

import os

import pytest
from pyspark.sql import functions as F

from dawnframe.plans import registry, registry_queries
from dawnframe.sources import logs

registry.load()
SF = "/root/testdata/sf0.001"


def sizes(path):
    return {f: os.path.getsize(os.path.join(top, f)) for top, _, files in os.walk(path) for f in files if f.startswith("part-")}


def test_dumps_are_compressed_and_split(spark, tmp_path):
    rows = spark.range(0, logs.PACKED["maxRecordsPerFile"] + 10, 1, 1).select(F.col("id").alias("l_orderkey"), (F.col("id") % 7).alias("l_linenumber"), F.when(F.col("id") % 3 > 0, "名").alias("flag"))
    logs.dump_all({"t": rows}, f"{tmp_path}/all", packed=True)
    logs.table_dump(rows, f"{tmp_path}/one", packed=True)
    plain = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1)).first()[0]
    for path in (f"{tmp_path}/all/tables/t", f"{tmp_path}/one"):
        files = sizes(path)
        assert sum(files.values()) < plain / 4 and len(files) == 2
    assert [tuple(r) for r in logs.verify_dump(spark, f"{tmp_path}/all").collect()] == [("t", rows.count(), True)]
    back = logs.restore(spark, f"{tmp_path}/one", rows.schema)
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["a6_dump_all", "a6_dump_restore"])
def test_queries_pack_their_dumps(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(registry_queries, "_folder", lambda spark, what: f"{tmp_path}/{what}")
    assert registry.QUERIES[name](spark, SF).count()
    rows = [f for folder in ("dump", "dump-all/tables") for f in sizes(f"{tmp_path}/{folder}")]
    assert rows and all(f.endswith(".json.gz") for f in rows)
