"""Deeply nested semi-structured records as related flat tables.

Method: single-pass tagged emission. A depth-first visitor walks each record once and puts out rows of
(table tag, primary key, parent key, payload); the rows are written partitioned by tag, and each table
is read from its partition with its own schema. One pass over the records thus serves all tables.

The visitor keeps its own stack, so depth is no limit of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import pick
from vellum.storage import materialize

#: Schema of each table's payload.
TABLES = {
    "element": "tag string, xpath string, parent_xpath string, depth int, wrapped boolean",
    "attribute": "name string, value string",
    "text": "kind string, position int, text string",
}
_ROW = "table string, tree_no long, node int, parent int, payload string"


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _find_top(record: object) -> tuple[dict | None, bool, str | None]:
    """The outermost object under ``parent_element``, whether it was wrapped, and the xpath beside it or, if none is there, the nearest above."""
    todo: list[tuple[object, str | None]] = [(record, None)]
    while todo:
        value, xpath = todo.pop()
        if isinstance(value, dict):
            own = value.get("xpath")
            xpath = own if isinstance(own, str) and own else xpath
            top, wrapped = _unwrap(value.get("parent_element"))
            if top is not None:
                return top, wrapped, xpath
            todo.extend((v, xpath) for k, v in reversed(value.items()) if isinstance(v, dict | list))
        elif isinstance(value, list):
            todo.extend((v, xpath) for v in reversed(value))
    return None, False, None


def _unwrap(value: object) -> tuple[dict | None, bool]:
    """The element within any ``abbr_element`` wrappers, and whether there was one; None for anything without a tag."""
    wrapped = False
    while isinstance(value, dict) and "tag" not in value and isinstance(value.get("abbr_element"), dict):
        value, wrapped = value["abbr_element"], True
    return (value, wrapped) if isinstance(value, dict) and isinstance(value.get("tag"), str) and value["tag"] else (None, wrapped)


def _attributes(value: object) -> Iterator[tuple[str, object]]:
    """Names and values of attributes given as an object, or as a list of objects with ``name`` and ``value``."""
    if isinstance(value, dict):
        yield from value.items()
    elif isinstance(value, list):
        for item in value:
            if isinstance(item, dict) and isinstance(item.get("name"), str):
                yield item["name"], item.get("value")


def _as_text(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)


def visit(tree_no: int | None, payload: str | None) -> Iterator[tuple[str, int | None, int, int | None, dict]]:
    """Rows of one record: table, tree_no, node, parent, payload. ``node`` numbers elements in document order.

    Nothing comes of null, of what is not valid JSON, or of a record without ``parent_element``.
    """
    try:
        record = json.loads(payload, parse_constant=_refuse) if payload is not None else None
    except (ValueError, RecursionError):
        return
    top, wrapped, xpath = _find_top(record)
    if top is None:
        return
    own = top.get("xpath")
    xpath = xpath if xpath is not None else own if isinstance(own, str) and own else f"/{top['tag']}[1]"
    numbered = 0
    todo = [(top, wrapped, None, "", xpath, 0)]
    while todo:
        element, wrapped, parent, parent_xpath, xpath, depth = todo.pop()
        node, numbered = numbered, numbered + 1
        yield "element", tree_no, node, parent, {"tag": element["tag"], "xpath": xpath, "parent_xpath": parent_xpath, "depth": depth, "wrapped": wrapped}
        for name, value in _attributes(element.get("attrs")):
            yield "attribute", tree_no, node, parent, {"name": name, "value": _as_text(value)}
        for kind in ("text", "tail"):
            if element.get(kind) not in (None, ""):
                yield "text", tree_no, node, parent, {"kind": kind, "position": 0, "text": _as_text(element[kind])}
        children = element.get("children")
        seen: dict[str, int] = {}
        below = []
        for position, child in enumerate(children if isinstance(children, list) else [] if children is None else [children]):
            inner, is_wrapped = _unwrap(child)
            if inner is not None:
                seen[inner["tag"]] = k = seen.get(inner["tag"], 0) + 1
                below.append((inner, is_wrapped, node, xpath, f"{xpath}/{inner['tag']}[{k}]", depth + 1))
            elif isinstance(child, str) and child:
                yield "text", tree_no, node, parent, {"kind": "child", "position": position, "text": child}
        todo.extend(reversed(below))


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[tuple] = []
        for tree_no, payload in zip(pdf["tree_no"], pdf["payload"], strict=True):
            for table, tree, node, parent, body in visit(None if pd.isna(tree_no) else int(tree_no), payload):
                rows.append((table, tree, node, parent, json.dumps(body, ensure_ascii=False)))
            if len(rows) > 50_000:
                yield _frame(rows)
                rows = []
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["table", "tree_no", "node", "parent", "payload"])
    return pdf.astype({"tree_no": "Int64", "node": "Int32", "parent": "Int32"})


def latest_trees(records: DataFrame) -> DataFrame:
    """``tree_no``, ``payload``: a repeated ``tree_no`` once, as loaded last. Rows without ``tree_no`` stay apart."""
    given = records.select("tree_no", "payload", "loaded_at")
    once = pick.by_key(given.where("tree_no IS NOT NULL"), "tree_no", ["loaded_at"], last=True)
    return once.unionByName(given.where("tree_no IS NULL")).drop("loaded_at")


def emit(records: DataFrame) -> DataFrame:
    """Tagged rows of all records: ``table``, ``tree_no``, ``node``, ``parent`` and ``payload`` as JSON.

    (``tree_no``, ``node``) is the key of an element and of what belongs to it, ``parent`` the ``node`` of the
    element above, null at the top. Unreadable payloads give no rows.
    """
    return latest_trees(records).mapInPandas(_emit, _ROW)


def _typed(rows: DataFrame, table: str) -> DataFrame:
    return rows.where(F.col("table") == table).withColumn("x", F.from_json("payload", TABLES[table])).select("tree_no", "node", "parent", "x.*")


def flatten(records: DataFrame) -> dict[str, DataFrame]:
    """All tables by name, from one pass over ``records``, written partitioned by tag in the shared folder."""
    rows = materialize(emit(records), partition_by="table")
    return {table: _typed(rows, table) for table in TABLES}
