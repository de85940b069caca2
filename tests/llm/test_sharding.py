"""The hash tree: the contract's columns, what growth and changed weights move, odd input."""

import collections
import zlib

from pyspark.sql import functions as F

from dawnframe.llm import sharding
from dawnframe.llm.sharding import Leaf

SCHEMA = "doc_id long, text string, size string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def test_manifest(spark):
    rows = [(i, f"té{i}€" * (i % 5)) for i in range(3000)] + [(5000, None), (5001, ""), (5002, "same"), (5002, "same"), (None, "a"), (None, "b")]
    got = sharding.manifest(docs(spark, rows), sharding.even()).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    facts = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, *facts(t)) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    grown = sum(r.grown_shard == 16 for r in got)
    assert 0.7 * len(rows) / 17 < grown < 1.3 * len(rows) / 17
    assert all(0.7 * len(rows) / 16 < len(s) < 1.3 * len(rows) / 16 for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == len({r.shard for r in got if r.doc_id == 5002}) == 1
    assert sharding.manifest(docs(spark, []), sharding.even()).count() == 0


def moved(spark, before, after, n=4000):
    return {(r["from"], r["to"]): r.n for r in sharding.moves(spark.range(n).withColumnRenamed("id", "doc_id"), before, after).collect() if r["from"] != r["to"]}


def test_growth_moves_keys_only_into_the_new_shard(spark):
    tree = sharding.even(2, 1, 3)
    for _ in range(3):
        after = sharding.grown(tree, 0.5)
        assert {to for _, to in moved(spark, tree, after)} == {len(tree)}
        tree = after


def test_changes_stay_in_their_subtree(spark):
    tree = [Leaf("a", "1", 0, 2), Leaf("a", "1", 1, 2), Leaf("a", "2", 2, 2), Leaf("b", "1", 3, 2), Leaf("b", "1", 4, 2)]
    in_rack = [x._replace(weight={0: 1, 1: 3}.get(x.shard, x.weight)) for x in tree]
    assert set(moved(spark, tree, in_rack)) == {(0, 1)}
    in_region = [x._replace(weight={0: 1, 1: 1, 2: 4}.get(x.shard, x.weight)) for x in tree]
    assert set(moved(spark, tree, in_region)) == {(0, 2), (1, 2)}
    dropped = [x._replace(weight=0 if x.shard == 4 else x.weight) for x in tree]
    assert all(to != 4 and a in (3, 4) for a, to in moved(spark, tree, dropped))  # region b shrinks: it only loses keys


def test_shares_follow_the_weights(spark):
    tree = [Leaf("a", "1", 0, 1), Leaf("a", "2", 1, 2), Leaf("b", "1", 2, 5)]
    rows = spark.range(20000).groupBy(sharding.shard_of(F.col("id"), tree).alias("shard")).count().collect()
    assert all(abs(r["count"] / 20000 - {0: 1, 1: 2, 2: 5}[r.shard] / 8) < 0.02 for r in rows) and len(rows) == 3


def test_files_hold_every_document(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)]
    sharding.write(docs(spark, rows).drop("shard"), sharding.even(), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).withColumn("again", sharding.shard_of(F.col("doc_id"), sharding.even()))
    assert back.count() == 200 and back.where("shard <> again").count() == 0


def test_bad_trees():
    import pytest

    with pytest.raises(ValueError, match="positive"):
        sharding.shard_of(F.lit(1), [Leaf("a", "1", 0, 0)])
    with pytest.raises(ValueError, match="two places"):
        sharding.shard_of(F.lit(1), [Leaf("a", "1", 0), Leaf("b", "1", 0)])
