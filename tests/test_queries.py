"""Every registered query against its SQL, run by DuckDB on the smallest tables."""

import math
import os

import pytest

from dawnframe.plans import registry
from dawnframe.tables import TABLES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
registry.load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    found = registry.QUERIES[name](spark, SF)
    expected = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(row[columns.index(c)]) for c in order) for row in expected.fetchall())
    got = sorted(tuple(plain(row[c]) for c in order) for row in found.collect())
    assert got == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry_gives_rows(spark):
    assert registry.QUERIES[registry.FLAGSHIP](spark, SF).count() == 5
