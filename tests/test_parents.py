"""Rows told apart by whether their parent exists: tasks of bounded rows, one pass."""

from dawnframe.operators import keyed
from dawnframe.plans import registry

registry.load()
ROWS = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, None)]


def test_both_outcomes(spark):
    rows = spark.createDataFrame(ROWS, "plan long, x string")
    parent = spark.createDataFrame([(1,), (1,), (3,), (None,)], "id long")
    found = keyed.has_parent(rows, parent, "plan", "id", "accepted")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(p, x, p in (1, 3)) for p, x in ROWS]))
    kept, refused = keyed.with_parent(rows, parent, "plan", "id")
    assert kept.columns == refused.columns == rows.columns
    assert (kept.count(), refused.count()) == (3, 2)


def test_tasks_have_bounded_rows(spark, tmp_path, monkeypatch):
    """However few partitions the session asks for, and however well the shuffle packs."""
    monkeypatch.setattr(keyed, "ROWS_A_TASK", 1000, raising=False)
    lines = spark.range(40000).selectExpr("id div 4 AS l_orderkey", "int(id % 4) AS l_linenumber", "'R' AS l_returnflag")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10000).selectExpr("id AS o_orderkey", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.QUERIES["r13_add_topic"](spark, str(tmp_path))
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 40000 and max(sizes) < 2000
