"""Queries hand whole texts and groups to their operators."""

import os

import pytest
from pyspark.sql import functions as F

from dawnframe.operators import markdown, news
from dawnframe.plans import registry
from dawnframe.tables import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
registry.load()


def test_locale_is_routed_by_the_whole_text(spark, monkeypatch):
    monkeypatch.setattr(news, "locale_route", lambda query: F.length(query))
    want = {r.doc_id: r.n + 2 * (r.doc_id % 5 == 0) for r in table(spark, SF, "documents").select("doc_id", F.length("text").alias("n")).collect()}
    assert {r.doc_id: r.locale for r in registry.QUERIES["n11_locale_route"](spark, SF).collect()} == want


@pytest.mark.parametrize("name, operator", [("n14_intro_summary", "intro_summary"), ("n16_stance", "stance")])
def test_summaries_read_the_whole_text(spark, monkeypatch, name, operator):
    monkeypatch.setattr(markdown, operator, lambda md, *_: F.length(md))
    plain = F.length(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")))
    want = {r.doc_id: r.n + len("## H\n\n\n\nrest") for r in table(spark, SF, "documents").where("doc_id % 3 = 1").select("doc_id", plain.alias("n")).collect()}
    found = {r[0]: r[1] for r in registry.QUERIES[name](spark, SF).where("doc_id % 3 = 1").collect()}
    assert found == want and max(want.values()) > 1000


def test_no_group_becomes_one_value(spark):
    plan = lambda name: registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan("q5_index_or_nodata")
    below = plan("n13_extract_links").split("collect_list", 1)[1]
    assert "row_number()" in below  # what is collected are the first links by rank


def test_written_tables_are_discarded_but_for_the_newest(spark):
    from dawnframe import durable

    start = durable.mark()
    first, second, last = (durable.written(spark.range(n), "discard") for n in (1, 2, 3))
    durable.discard_since(spark, start)
    assert last.count() == 3 and durable.mark() == start + 1
    for gone in (first, second):
        with pytest.raises(Exception, match="exist|FileNotFound|FAILED_READ"):
            gone.count()


def test_only_the_own_threads_tables_are_discarded(spark):
    import threading

    from dawnframe import durable

    others = []
    start = durable.mark()
    durable.written(spark.range(1), "own")
    thread = threading.Thread(target=lambda: others.append(durable.written(spark.range(4), "other")))
    thread.start()
    thread.join()
    durable.written(spark.range(2), "own")
    durable.discard_since(spark, start)
    assert others[0].count() == 4 and durable.mark() == start + 1


def test_hot_keys_are_numbered_over_all_partitions(spark):
    from dawnframe.operators.topk import numbered

    rows = spark.range(0, 5000, 1, 7).selectExpr("CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 2 = 0 THEN NULL ELSE concat('k', id % 11) END AS k", "id * 7919 % 5003 AS v")
    got = {(r.k, r.v): r.n for r in numbered(rows, ["k"], [F.col("v").desc()], "n").collect()}
    pairs = [(r.k, r.v) for r in rows.collect()]
    want = {(k, v): n for k in {k for k, _ in pairs} for n, v in enumerate(sorted((v for o, v in pairs if o == k), reverse=True), 1)}
    assert got == want
