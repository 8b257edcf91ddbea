"""Every query that has SQL gives the SQL's rows on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def in_order(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(plain(r[i])) for i in at) for r in rows), [columns[i] for i in at]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        want = db.sql(entry.oracle_sql()[name])
        assert in_order(rows, df.columns) == in_order(want.fetchall(), want.columns)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
