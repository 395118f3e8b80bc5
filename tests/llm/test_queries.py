"""Queries of the training-data operators against their SQL, over the smallest tables."""

from __future__ import annotations

import os

import pytest

from vellum.llm.queries import QUERIES, SQL
from vellum.storage import scope, shared_dir

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p1_found": {"file_a": "string", "file_b": "string"}, "p2_found": {"abbr_no": "bigint", "field": "string", "form_id": "bigint"}, "p3_found": {"abbr_no": "bigint", "field": "string", "lang": "string"},
    "p4_found": {"entry_a": "bigint", "entry_b": "bigint"}, "p6_found": {"field": "string", "term": "string", "mark": "string"}, "p7_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"doc_id": "bigint", "subject_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scope():
        df = QUERIES[name](spark, FOLDER)
        rows = [tuple(r) for r in df.collect()]
    assert set(os.listdir(folder)) == before
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    if name in SQL:
        con = duckdb.connect()
        for table in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{FOLDER}/{table}'")
        made = con.execute(SQL[name])
        columns = [d[0] for d in made.description]
        order = [df.columns.index(c) for c in columns]
        assert sorted(tuple(str(r[i]) for i in order) for r in rows) == sorted(tuple(map(str, r)) for r in made.fetchall())


def test_nothing_else_imports_this_package():
    import vellum

    root = os.path.dirname(vellum.__file__)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "vellum.llm" not in f.read(), name
