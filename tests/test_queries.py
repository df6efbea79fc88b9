"""Every registered query runs on the smallest tables, and agrees with its SQL where it has some."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["query_id", "id"]


@pytest.mark.parametrize("name", sorted(n for plans in entry._PLANS for n in plans.queries))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in found.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(found.columns)
        assert norm(columns, r.fetchall()) == norm(found.columns, rows)
