"""Queries over nested element records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.operators import nested


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/element_records.parquet")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Xpath and parent's xpath of every element, read from the tables written in one pass."""
    return nested.flatten(_records(spark, folder))["element"].select("tree_no", "xpath", "parent_xpath")


def p5_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Every attribute, with the key of its element."""
    return nested.flatten(_records(spark, folder))["attribute"].drop("parent")


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of text, with the key of its element."""
    return nested.flatten(_records(spark, folder))["text"].drop("parent")


def p5_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Elements from one pass for all three tables, with the number of their attributes and texts."""
    tables = nested.flatten(_records(spark, folder))
    count = lambda t, n: tables[t].groupBy("tree_no", "node").count().withColumnRenamed("count", n)
    joined = tables["element"].join(count("attribute", "attributes"), ["tree_no", "node"], "left").join(count("text", "texts"), ["tree_no", "node"], "left")
    return joined.na.fill(0, ["attributes", "texts"]).select("tree_no", "node", "parent", "tag", "xpath", "depth", "attributes", "texts")


QUERIES = {f.__name__: f for f in (p5_found, p5_attributes, p5_texts, p5_tables)}

# Elements with their place among the children of each element above, from which their numbers in document order follow.
_CHILDREN = "CASE json_type(el -> '$.children') WHEN 'ARRAY' THEN CAST(el -> '$.children' AS JSON[]) WHEN 'OBJECT' THEN [el -> '$.children'] ELSE CAST([] AS JSON[]) END"
_ELEMENTS = f"""
        once AS (SELECT tree_no, arg_max(payload, loaded_at) AS p FROM element_records GROUP BY tree_no),
        good AS (SELECT tree_no, CAST(p AS JSON) AS p FROM once WHERE json_valid(p)),
        e AS (SELECT tree_no, coalesce(p ->> '$.xpath', p ->> '$.record.xpath') AS xpath, '' AS parent_xpath, CAST([] AS BIGINT[]) AS place,
                     coalesce(p -> '$.parent_element', p -> '$.record.info.parent_element') AS el FROM good
              UNION ALL
              SELECT tree_no, xpath || '/' || (el ->> '$.tag') || '[' || row_number() OVER (PARTITION BY tree_no, xpath, el ->> '$.tag' ORDER BY i) || ']', xpath, list_append(place, i), el
              FROM (SELECT tree_no, xpath, place, i, coalesce(c -> '$.abbr_element', c) AS el
                    FROM (SELECT tree_no, xpath, place, i, cs[i] AS c FROM (SELECT tree_no, xpath, place, {_CHILDREN} AS cs FROM e), unnest(generate_series(1, len(cs))) AS s(i)))
              WHERE json_type(el) = 'OBJECT'),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY tree_no ORDER BY place) - 1 AS INTEGER) AS node FROM e WHERE el IS NOT NULL)"""
_ATTRIBUTES = """
        a AS (SELECT tree_no, node, k AS name, json_extract_string(el, '$.attrs."' || k || '"') AS value FROM n, unnest(json_keys(el, '$.attrs')) AS s(k) WHERE json_type(el -> '$.attrs') = 'OBJECT'
              UNION ALL
              SELECT tree_no, node, x ->> '$.name', x ->> '$.value' FROM (SELECT tree_no, node, CAST(el -> '$.attrs' AS JSON[]) AS xs FROM n WHERE json_type(el -> '$.attrs') = 'ARRAY'), unnest(xs) AS s(x))"""
_TEXTS = f"""
        t AS (SELECT tree_no, node, kind, CAST(0 AS INTEGER) AS position, text FROM (SELECT tree_no, node, 'text' AS kind, el ->> '$.text' AS text FROM n UNION ALL SELECT tree_no, node, 'tail', el ->> '$.tail' FROM n) WHERE text <> ''
              UNION ALL
              SELECT tree_no, node, 'child', CAST(i - 1 AS INTEGER), cs[i] ->> '$' FROM (SELECT tree_no, node, {_CHILDREN} AS cs FROM n), unnest(generate_series(1, len(cs))) AS s(i) WHERE json_type(cs[i]) = 'VARCHAR' AND (cs[i] ->> '$') <> '')"""

SQL = {
    "p5_found": f"WITH RECURSIVE {_ELEMENTS} SELECT tree_no, xpath, parent_xpath FROM n",
    "p5_attributes": f"WITH RECURSIVE {_ELEMENTS}, {_ATTRIBUTES} SELECT tree_no, node, name, value FROM a",
    "p5_texts": f"WITH RECURSIVE {_ELEMENTS}, {_TEXTS} SELECT tree_no, node, kind, position, text FROM t",
    "p5_tables": f"""
        WITH RECURSIVE {_ELEMENTS}, {_ATTRIBUTES}, {_TEXTS},
        ca AS (SELECT tree_no, node, count(*) AS k FROM a GROUP BY ALL), ct AS (SELECT tree_no, node, count(*) AS k FROM t GROUP BY ALL)
        SELECT n.tree_no, n.node, up.node AS parent, n.el ->> '$.tag' AS tag, n.xpath, CAST(len(n.place) AS INTEGER) AS depth, coalesce(ca.k, 0) AS attributes, coalesce(ct.k, 0) AS texts
        FROM n LEFT JOIN n up ON up.tree_no = n.tree_no AND len(n.place) > 0 AND up.place = n.place[:-2] LEFT JOIN ca ON ca.tree_no = n.tree_no AND ca.node = n.node LEFT JOIN ct ON ct.tree_no = n.tree_no AND ct.node = n.node""",
}
