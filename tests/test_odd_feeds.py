"""Feeds made of pages with texts that XML can't hold or changes, without texts, or with ids below zero, against the queries' SQL."""

import pytest

from dawnframe.plans import registry

duckdb = pytest.importorskip("duckdb")
registry.load()
TITLES = ["a\x01b", "a\x00b\x1f", "\ta b\t", "a\rb", "\ra\x85", "a b", " a　", " ", "\t", "encoded:a%20b", "null:", "￾a", "plain +%41"]
URLS = [None, "", "https://h/\x01x", " https://h/x ", "  ", "\r", "https://a\tb/", "ftp://h/x", "null:x"]
#: Of a feed one page is odd, at another place each time.
PAGES = [
    *[(40 * n + n % 5 + 1, f"https://h{n}.example/", f"<title>{t}</title>") for n, t in enumerate(TITLES * 3)],
    *[(40 * n + n % 5 + 1, u, "<title>t</title>") for n, u in enumerate(URLS * 3, 50)],
    *[(40 * n + n % 5 + 1, "https://h/", h) for n, h in enumerate([None, "", "<TITLE>x</TITLE>", "<title>a\nb</title>"] * 3, 90)],
]


def check(spark, folder, name, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    expected = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    found = registry.QUERIES[name](spark, str(folder)).select(*columns)
    want = expected.fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and want


@pytest.mark.parametrize("name", ["a2_feed_files", "a2_rss_items", "a3_rss_items_with_source"])
def test_odd_texts(spark, tmp_path, name):
    odd = {p[0]: p for p in PAGES}
    check(spark, tmp_path, name, [odd.get(n, (n, f"https://h{n % 5}.example/{n}", f"<title>t {n}</title>")) for n in range(4200)])


@pytest.mark.parametrize("name", ["a2_feed_files", "a2_rss_items", "a3_rss_items_with_source"])
def test_ids_below_zero(spark, tmp_path, name):
    check(spark, tmp_path, name, [(n, f"https://h{n % 5}.example/{n}", f"<title>t {n}</title>") for n in range(-200, 200)])


@pytest.mark.parametrize("name", ["a2_rss_items", "a3_rss_items_with_source"])
def test_pages_with_one_id_keep_their_order(spark, tmp_path, name):
    check(spark, tmp_path, name, [(n // 3, f"https://h{-n % 7}.example/{n}", f"<title>t {n * 7919 % 1000}</title>") for n in range(1200)])
