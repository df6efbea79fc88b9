"""The training-data queries run on the smallest tables, and agree with their SQL where they have some."""

import glob
import os

import duckdb
import pytest

from weftline.llm import queries as llm
from weftline.sources.session import ship_package

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


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, duck, name):
    ship_package(spark)
    found = llm.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in found.collect()]
    if sql := llm.oracle_sql().get(name):
        r = duck.execute(sql)
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(found.columns)
        assert norm(columns, r.fetchall()) == norm(found.columns, rows)
