"""Every registered query of the core against its SQL, over the smallest tables."""

from __future__ import annotations

import os

import pytest

from vellum.plans.catalogue import QUERIES, SQL
from vellum.storage import scope, shared_dir

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def cells(rows, columns):
    key = lambda v: "" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(key(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scope():
        df = QUERIES[name](spark, FOLDER)
        rows = [tuple(r) for r in df.collect()]
    assert set(os.listdir(folder)) == before
    if name in SQL:
        made = database.execute(SQL[name])
        columns = [d[0] for d in made.description]
        assert sorted(columns) == sorted(df.columns)
        assert cells(rows, df.columns) == cells(made.fetchall(), columns)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
