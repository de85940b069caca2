"""Feeds made of pages whose titles were cut within a reference, or hold bare marks, against the queries' SQL."""

import pytest

from dawnframe.plans import registry

duckdb = pytest.importorskip("duckdb")
registry.load()
TITLES = ["ver &am", "a &amp;&amp;&amp", "a & b", "&amp;lt; once", "1 < 2 > 0", "&quot;said&quot; &#38; &nbsp;", "day 33 of 44", "", "plain &lt;b&gt;"]


@pytest.mark.parametrize("name", ["a2_feed_files", "a2_rss_items", "a3_rss_items_with_source"])
def test_titles_with_bare_marks(spark, tmp_path, name):
    rows = [(n, f"https://h{n % 5}.example/a?x={n}&y=1", f"<html><title>{TITLES[n % len(TITLES)]}</title>text</html>") for n in range(1, 400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    found = registry.QUERIES[name](spark, str(tmp_path)).select(*columns)
    want = expected.fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and want
