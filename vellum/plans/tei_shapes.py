"""Queries over TEI documents of many shapes: for each scanned record one document, with a paragraph for each shape an abbreviation may have.

The record's texts fill the paragraphs. The SQL states what each shape must give, from the rules, and never reads a document.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import tei, xmlpatch
from vellum.operators.sizes import spread
from vellum.plans.tables import sql_markers, sql_strip, sql_words, table

_STROKE = '<g ref="char:cmbAbbrStroke">̄</g>'
_EMPTY_STROKE = '<g ref="char:cmbAbbrStroke"/>'
_QUE = '<g ref="char:abque"/>'
_NS = 'xmlns="http://www.tei-c.org/ns/1.0"'

#: Paragraphs by shape: {b} a text before, {t} the abbreviation, {a} a text after; none of them blank.
SHAPES = [
    '{b} <abbr xml:id="i1">{t}</abbr> m <hi>k</hi> n <abbr>v</abbr> {a}',
    "{b} <abbr>{t}</abbr><expan>e</expan> {a}",
    f"{{b}} {_QUE} {{a}}",
    f"{{b}} <abbr>{{t}}<am>w{_QUE}</am></abbr> {{a}}",
    f"{{b}} <am>{{t}}{_STROKE}u</am> {{a}}",
    f"{{b}} <choice><abbr>{{t}}<am>{_QUE}</am></abbr></choice> {{a}}",
    f"<seg><hi>brethre</hi></seg>{_EMPTY_STROKE}",
    f"{_EMPTY_STROKE}{{a}}",
    f'{{b}} <am n="x">{_QUE}</am> {{a}}',
    '{b} <g ref="char:other">q</g> {a}',
    "{b} <expan><am>{t}</am><ex>s</ex></expan> {a}",
    '{b} <choice><abbr xml:id="i2">{t}</abbr><expan>old</expan></choice> {a}',
    f"{{b}} <choice><abbr>{{t}}<am>{_QUE}</am></abbr><expan>old</expan></choice> {{a}}",
]


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """``file_path`` (the record's number), ``xml``: a paragraph of each shape."""
    r = spread(table(spark, folder, "abbr_records").select("abbr_no", "abbr_text", "context_before", "context_after"))
    text = lambda c: F.coalesce(c, F.lit(""))
    filled = {"{b}": _escaped(F.concat(F.lit("x "), text("context_before"))), "{t}": _escaped(F.concat(F.lit("y"), text("abbr_text"))), "{a}": _escaped(F.concat(text("context_after"), F.lit(" z")))}
    body = "".join(f"<p>{p}</p>" for p in SHAPES)
    pieces = re.split(r"(\{[bta]\})", f"<TEI {_NS}><text><body>{body}</body></text></TEI>")
    return r.select(F.col("abbr_no").cast("string").alias("file_path"), F.concat(*(filled.get(x, F.lit(x)) for x in pieces)).alias("xml"))


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("abbr_no", F.col("file_path").cast("long")).drop("file_path")


def tei_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """What each element of each shape gives, those already expanded included."""
    found = _number(tei.abbreviations(tei.scan_documents(sources(spark, folder)), include_expanded=True))
    return found.select("abbr_no", "kind", "node_ord", "parent_tag", "abbr_id", "xpath", "abbr_text", "context_before", "context_after", "normalized_form", "already_expanded")


def tei_shapes_words(spark: SparkSession, folder: str) -> DataFrame:
    """Five words on either side of each element of each shape."""
    found = _number(tei.abbreviations(tei.scan_documents(sources(spark, folder)), include_expanded=True))
    return found.select("abbr_no", "node_ord", "words_before", "words_after")


def tei_shapes_places(spark: SparkSession, folder: str) -> DataFrame:
    """Each unexpanded element's place among those of its document: all ``abbr``, then ``g``, then ``am``."""
    found = _number(tei.abbreviations(tei.scan_documents(sources(spark, folder))))
    return found.select("abbr_no", "node_ord", F.col("number").cast("long").alias("number"), F.col("of").cast("long").alias("of"))


def _patched(spark: SparkSession, folder: str, kind: str, **options: bool) -> DataFrame:
    documents = sources(spark, folder)
    found = tei.abbreviations(tei.scan_documents(documents), include_expanded=True).where(F.col("kind") == kind)
    done = xmlpatch.patch_documents(documents, found.select("file_path", "kind_ord", "node_ord", F.lit("E&").alias("expansion")), **options)
    paragraphs = F.regexp_extract_all("xml", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return _number(done.select("file_path", "expanded", F.posexplode(paragraphs).alias("at", "paragraph"))).select("abbr_no", "expanded", F.col("at").cast("long").alias("shape"), "paragraph")


def tei_patch_abbr(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs after an expansion of every ``abbr``, with ids."""
    return _patched(spark, folder, "abbr")


def tei_patch_abbr_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The same where an expansion and its ``abbr`` are put in a ``choice``."""
    return _patched(spark, folder, "abbr", use_choice=True)


def tei_patch_g(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs after an expansion of every ``g`` that counts, with ids."""
    return _patched(spark, folder, "g")


def tei_patch_am(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs after an expansion of every ``am``, with ids."""
    return _patched(spark, folder, "am")


#: Roots that a document may have, whether that is well-formed, and whether it is TEI.
ROOTS = [("tei", f"<TEI {_NS}>{{t}}</TEI>", True, True), ("other root", f"<div {_NS}>{{t}}</div>", True, True), ("prefixed", '<t:TEI xmlns:t="http://www.tei-c.org/ns/1.0">{t}</t:TEI>', True, True), ("no namespace", "<TEI>{t}</TEI>", True, False), ("other namespace", '<TEI xmlns="urn:x">{t}</TEI>', True, False), ("unclosed", f"<TEI {_NS}>{{t}}", False, False)]


def tei_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Whether documents with these roots can be read, and are TEI."""
    records = spread(table(spark, folder, "abbr_records").select("abbr_no", "abbr_text"))
    made = [F.struct(F.lit(name).alias("root"), F.replace(F.lit(xml), F.lit("{t}"), _escaped(F.coalesce("abbr_text", F.lit("")))).alias("xml")) for name, xml, _, _ in ROOTS]
    documents = records.select("abbr_no", F.explode(F.array(*made)).alias("d")).select(F.concat_ws("#", "abbr_no", "d.root").alias("file_path"), "d.xml")
    scanned = tei.scan_documents(documents)
    return scanned.select(F.substring_index("file_path", "#", 1).cast("long").alias("abbr_no"), F.substring_index("file_path", "#", -1).alias("root"), F.col("error").isNull().alias("readable"), "valid_tei")


QUERIES = {f.__name__: f for f in (tei_shapes, tei_shapes_words, tei_shapes_places, tei_patch_abbr, tei_patch_abbr_choice, tei_patch_g, tei_patch_am, tei_roots)}

_TEXTS = f"""r AS (SELECT abbr_no, 'x ' || coalesce(context_before, '') AS b, 'y' || coalesce(abbr_text, '') AS t, coalesce(context_after, '') || ' z' AS a FROM abbr_records),
        s AS (SELECT *, {sql_strip('b')} AS sb, {sql_strip('t')} AS st, {sql_strip('a')} AS sa FROM r)"""
_P = lambda n, rest: f"'/TEI[1]/text[1]/body[1]/p[{n}]/{rest}'"
_FORM = sql_markers("st")
# Of each element: kind, number in document order, parent, id, path, text, text before and after, written form, whether expanded, words before and after.
_B, _A = f"{sql_words('b')}[-5:]", f"{sql_words('a')}[:5]"
_T = f"{sql_words('t')}[-5:]"
_ELEMENTS = [
    ("abbr", 4, "p", "'i1'", _P(1, "abbr[1]"), "st", "sb", "'k'", _FORM, False, _B, sql_words("'m k n v ' || a") + "[:5]"),
    ("abbr", 6, "p", "NULL", _P(1, "abbr[2]"), "'v'", "'n'", "sa", "'v'", False, sql_words("b || ' ' || t || ' m k n'") + "[-5:]", _A),
    ("abbr", 8, "p", "NULL", _P(2, "abbr[1]"), "st", "sb", "'e'", _FORM, True, _B, sql_words("'e ' || a") + "[:5]"),
    ("abbr", 13, "p", "NULL", _P(4, "abbr[1]"), "t || 'w'", "sb", "sa", sql_markers("t || 'w'"), False, _B, _A),
    ("abbr", 21, "choice", "NULL", _P(6, "choice[1]/abbr[1]"), "st", "''", "''", _FORM, False, _B, _A),
    ("abbr", 41, "choice", "'i2'", _P(12, "choice[1]/abbr[1]"), "st", "''", "'old'", _FORM, True, "[]", "['old']"),
    ("abbr", 45, "choice", "NULL", _P(13, "choice[1]/abbr[1]"), "st", "''", "'old'", _FORM, True, "[]", "['old']"),
    ("g", 11, "p", "NULL", _P(3, "g[1]"), "''", "sb", "sa", "sb || 'q$'", False, _B, _A),
    ("g", 15, "am", "NULL", _P(4, "abbr[1]/am[1]/g[1]"), "''", "'w'", "''", "'wq$'", False, "['w']", "[]"),
    ("g", 18, "am", "NULL", _P(5, "am[1]/g[1]"), "'̄'", "st", "'u'", "st || '$u'", False, _T, "['u']"),
    ("g", 23, "am", "NULL", _P(6, "choice[1]/abbr[1]/am[1]/g[1]"), "''", "''", "''", "'q$'", False, _T, "[]"),
    ("g", 27, "p", "NULL", _P(7, "g[1]"), "''", "''", "''", "'bre$thre'", False, "['brethre']", "[]"),
    ("g", 29, "p", "NULL", _P(8, "g[1]"), "''", "''", "sa", "'m$' || sa", False, "[]", _A),
    ("g", 32, "am", "NULL", _P(9, "am[1]/g[1]"), "''", "''", "''", "'q$'", False, _B, _A),
    ("g", 47, "am", "NULL", _P(13, "choice[1]/abbr[1]/am[1]/g[1]"), "''", "''", "''", "'q$'", False, _T, "[]"),
    ("am", 14, "abbr", "NULL", _P(4, "abbr[1]/am[1]"), "'w'", "st", "''", "'wq$'", False, _T, "[]"),
    ("am", 17, "p", "NULL", _P(5, "am[1]"), "t || '̄u'", "sb", "sa", "st || '$u'", False, _B, _A),
    ("am", 22, "abbr", "NULL", _P(6, "choice[1]/abbr[1]/am[1]"), "''", "st", "''", "'q$'", False, _T, "[]"),
    ("am", 31, "p", "NULL", _P(9, "am[1]"), "''", "sb", "sa", "'q$'", False, _B, _A),
    ("am", 46, "abbr", "NULL", _P(13, "choice[1]/abbr[1]/am[1]"), "''", "st", "''", "'q$'", True, _T, "[]"),
]


def _filled_sql(template: str) -> str:
    """A template as an SQL expression over the record's texts; #n becomes the id of the expansion of element n."""
    found = []
    for x in re.split(r"(\{[bta]\}|#\d+)", template):
        if x[:1] == "{":
            found.append(f"replace(replace(replace({x[1]}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
        elif x[:1] == "#":
            found.append(f"'xml:id=\"expan_' || substr(md5(abbr_no || '#{x[1:]}'), 1, 8) || '\"'")
        elif x:
            found.append("'" + x.replace("'", "''") + "'")
    return " || ".join(found)


_E = "E&amp;</expan>"
_SPELLED = lambda am: f"<expan>{am}<ex>E&amp;</ex></expan>"
_QUE_AM = f"<am>{_QUE}</am>"
#: Paragraphs that a patch of each kind changes; the others stay as they are. HASH stands for the sign itself.
_ABBR = {
    0: f'{{b}} <abbr xml:id="i1">{{t}}</abbr><expan corresp="HASHi1" #4>{_E} m <hi>k</hi> n <abbr>v</abbr><expan #6>{_E} {{a}}',
    1: f"{{b}} <abbr>{{t}}</abbr><expan #8>{_E}<expan>e</expan> {{a}}",
    3: f"{{b}} <abbr>{{t}}<am>w{_QUE}</am></abbr><expan #13>{_E} {{a}}",
    5: f"{{b}} <choice><abbr>{{t}}{_QUE_AM}</abbr><expan #21>{_E}</choice> {{a}}",
    11: f'{{b}} <choice><abbr xml:id="i2">{{t}}</abbr><expan>{_E}</choice> {{a}}',
    12: f"{{b}} <choice><abbr>{{t}}{_QUE_AM}</abbr><expan>{_E}</choice> {{a}}",
}
_ABBR_CHOICE = _ABBR | {
    0: f'{{b}} <choice><abbr xml:id="i1">{{t}}</abbr><expan corresp="HASHi1" #4>{_E}</choice> m <hi>k</hi> n <choice><abbr>v</abbr><expan #6>{_E}</choice> {{a}}',
    1: f"{{b}} <choice><abbr>{{t}}</abbr><expan #8>{_E}</choice><expan>e</expan> {{a}}",
    3: f"{{b}} <choice><abbr>{{t}}<am>w{_QUE}</am></abbr><expan #13>{_E}</choice> {{a}}",
}
_G = {
    2: f"{{b}} <choice><abbr>{_QUE_AM}</abbr>{_SPELLED(_QUE_AM)}</choice> {{a}}",
    3: f"{{b}} <choice><abbr>{{t}}<am>w{_QUE}</am></abbr>{_SPELLED(_QUE_AM)}</choice> {{a}}",
    4: f"{{b}} <am>{{t}}{_STROKE}<expan #18>{_E}u</am> {{a}}",
    5: f"{{b}} <choice><abbr>{{t}}{_QUE_AM}</abbr>{_SPELLED(_QUE_AM)}</choice> {{a}}",
    6: f"<seg><hi>brethre</hi></seg>{_EMPTY_STROKE}<expan #27>{_E}",
    7: f"{_EMPTY_STROKE}<expan #29>{_E}{{a}}",
    8: f'{{b}} <am n="x">{_QUE}</am> {{a}}<expan #32>{_E}',
    12: f"{{b}} <choice><abbr>{{t}}{_QUE_AM}</abbr>{_SPELLED(_QUE_AM)}</choice> {{a}}",
}
_AM = {
    3: f"{{b}} <choice><abbr>{{t}}<am>w{_QUE}</am></abbr>{_SPELLED(f'<am>w{_QUE}</am>')}</choice> {{a}}",
    4: f"{{b}} <am>{{t}}{_STROKE}u</am><expan #17>{_E} {{a}}",
    5: f"{{b}} <choice><abbr>{{t}}{_QUE_AM}</abbr>{_SPELLED(_QUE_AM)}</choice> {{a}}",
    8: f'{{b}} <am n="x">{_QUE}</am><expan #31>{_E} {{a}}',
    12: f"{{b}} <choice><abbr>{{t}}{_QUE_AM}</abbr>{_SPELLED(_QUE_AM)}</choice> {{a}}",
}


def _patch_sql(kind: str, changed: dict[int, str]) -> str:
    n = sum(e[0] == kind for e in _ELEMENTS)
    rows = [f"SELECT abbr_no, CAST({n} AS INTEGER) AS expanded, {i}::BIGINT AS shape, {_filled_sql(changed.get(i, p)).replace('HASH', '#')} AS paragraph FROM s" for i, p in enumerate(SHAPES)]
    return f"WITH {_TEXTS} " + " UNION ALL ".join(rows)


def _rows(row: Callable[[tuple], str]) -> str:
    return f"WITH {_TEXTS} " + " UNION ALL ".join(f"SELECT abbr_no, {row(e)} FROM s" for e in _ELEMENTS)


_OPEN = [e[1] for e in _ELEMENTS if not e[9]]
SQL = {
    "tei_shapes": _rows(
        lambda e: f"'{e[0]}' AS kind, CAST({e[1]} AS INTEGER) AS node_ord, '{e[2]}' AS parent_tag, {e[3]} AS abbr_id, {e[4]} AS xpath, {e[5]} AS abbr_text, {e[6]} AS context_before, {e[7]} AS context_after, {e[8]} AS normalized_form, {e[9]} AS already_expanded"
    ),
    "tei_shapes_words": _rows(lambda e: f"CAST({e[1]} AS INTEGER) AS node_ord, array_to_string({e[10]}, ' ') AS words_before, array_to_string({e[11]}, ' ') AS words_after"),
    "tei_shapes_places": f"SELECT abbr_no, CAST(o[i] AS INTEGER) AS node_ord, i AS number, {len(_OPEN)}::BIGINT AS of FROM (SELECT abbr_no, {_OPEN} AS o FROM abbr_records), unnest(generate_series(1, {len(_OPEN)})) AS u(i)",
    "tei_patch_abbr": _patch_sql("abbr", _ABBR),
    "tei_patch_abbr_choice": _patch_sql("abbr", _ABBR_CHOICE),
    "tei_patch_g": _patch_sql("g", _G),
    "tei_patch_am": _patch_sql("am", _AM),
    "tei_roots": " UNION ALL ".join(f"SELECT abbr_no, '{name}' AS root, {readable} AS readable, {valid} AS valid_tei FROM abbr_records" for name, _, readable, valid in ROOTS),
}
