from __future__ import annotations

import json
import random

from vellum.operators import nested

SCHEMA = "tree_no long, payload string, loaded_at timestamp, table string"


def frame(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(n, p, datetime(2025, 1, 1 + i % 28), "clash") for i, (n, p) in enumerate(rows)], SCHEMA)


def elements(payload):
    return [(b["xpath"], b["parent_xpath"]) for t, _, _, _, b in nested.visit(1, payload) if t == "element"]


def test_shapes():
    child = {"abbr_element": {"tag": "abbr", "attrs": [{"name": "a", "value": 1}, {"name": None}, 3], "children": {"tag": "g", "text": "t", "tail": None}}}
    top = {"tag": "p", "attrs": {"x": "y"}, "children": ["text", child, {"tag": "abbr", "xpath": "/wrong", "children": None}, {"no": "tag"}, None, 5]}
    rows = list(nested.visit(1, json.dumps({"record": {"xpath": "/T/p[2]", "info": {"parent_element": top}}})))
    assert [(b["xpath"], b["parent_xpath"], b["wrapped"]) for t, _, _, _, b in rows if t == "element"] == [("/T/p[2]", "", False), ("/T/p[2]/abbr[1]", "/T/p[2]", True), ("/T/p[2]/abbr[1]/g[1]", "/T/p[2]/abbr[1]", False), ("/T/p[2]/abbr[2]", "/T/p[2]", False)]
    assert [(n, b["name"], b["value"]) for t, _, n, _, b in rows if t == "attribute"] == [(0, "x", "y"), (1, "a", "1")]
    assert [(n, b["kind"], b["text"]) for t, _, n, _, b in rows if t == "text"] == [(0, "child", "text"), (2, "text", "t")]
    assert [p for t, _, _, p, _ in rows if t == "element"] == [None, 0, 1, 0]


def test_what_gives_nothing():
    for payload in (None, "", "{", "null", "[]", '{"parent_element": null}', '{"parent_element": {"text": "x"}}', '{"a": NaN}'):
        assert elements(payload) == []
    assert elements('{"parent_element": {"tag": "p"}}') == [("/p[1]", "")]
    assert elements('{"parent_element": {"abbr_element": {"tag": "p", "xpath": "/q"}}}') == [("/q", "")]


def test_deep():
    value = {"tag": "x"}
    for _ in range(300):
        value = {"tag": "x", "children": [value]}
    assert len(elements(json.dumps({"parent_element": value}))) == 301


def test_frames(spark):
    one = json.dumps({"parent_element": {"tag": "p", "children": [{"tag": "g", "attrs": {"a": None}}, "t"]}, "xpath": "/p"})
    two = json.dumps({"parent_element": {"tag": "q"}, "xpath": "/q"})
    df = frame(spark, [(1, one), (1, one), (2, "{"), (3, None), (None, two), (None, two), (4, one), (4, two)])
    found = nested.flatten(df)["element"]
    assert sorted((r["tree_no"] or 0, r["xpath"]) for r in found.collect()) == [(0, "/q"), (0, "/q"), (1, "/p"), (1, "/p/g[1]"), (4, "/q")]
    tables = nested.flatten(df)
    assert {k: v.count() for k, v in tables.items()} == {"element": 5, "attribute": 1, "text": 1}
    assert tables["attribute"].first().asDict() == {"tree_no": 1, "node": 1, "parent": 0, "name": "a", "value": None}
    assert all(v.count() == 0 for v in nested.flatten(df.limit(0)).values())


def test_against_recursion():
    rng = random.Random(1)

    def tree(depth):
        return {"tag": rng.choice("abc"), "children": [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else None}

    def walk(e, xpath, parent):
        out, seen = [(xpath, parent)], {}
        for c in e["children"] or []:
            seen[c["tag"]] = seen.get(c["tag"], 0) + 1
            out += walk(c, f"{xpath}/{c['tag']}[{seen[c['tag']]}]", xpath)
        return out

    for _ in range(20):
        t = tree(5)
        assert elements(json.dumps({"xpath": "/r", "parent_element": t})) == walk(t, "/r", "")


def test_found_reads_the_table_written_with_all_others(spark, tmp_path, monkeypatch):
    from vellum.plans.nested import p5_found

    made = []
    write = nested.materialize
    monkeypatch.setattr(nested, "materialize", lambda df, partition_by=None: made.append((partition_by, write(df, partition_by))) or made[-1][1])
    payload = json.dumps({"xpath": "/T[1]", "parent_element": {"tag": "T", "attrs": {"x": "y"}, "text": "t", "children": [{"tag": "p"}]}})
    frame(spark, [(1, payload), (2, None)]).write.parquet(str(tmp_path / "element_records.parquet"))
    assert sorted(tuple(r) for r in p5_found(spark, str(tmp_path)).collect()) == [(1, "/T[1]", ""), (1, "/T[1]/p[1]", "/T[1]")]
    assert [by for by, _ in made] == ["table"]
    assert {r["table"]: r["count"] for r in made[0][1].groupBy("table").count().collect()} == {"element": 2, "attribute": 1, "text": 1}
