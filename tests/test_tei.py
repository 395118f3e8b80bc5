from __future__ import annotations

import pytest

from vellum.operators import tei, xmlpatch
from vellum.operators.xmltree import parse, serialize

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'
MACRON = '<g ref="char:cmbAbbrStroke">̄</g>'
QUE = '<g ref="char:abque"/>'


def scan(body):
    return tei.scan(parse(f"<TEI {NS}>{body}</TEI>"))


def nodes(xml):
    return {(kind, i): n for i, (kind, _, n) in enumerate(tei.scan(parse(xml)))}


def expand(xml, kind, text="E", **options):
    options.setdefault("add_ids", False)
    xml = f"<body {NS}>{xml}</body>"
    target = next(n for n in parse(xml).walk() if n.local == kind)
    made, done = xmlpatch.patch("f", xml, [(target.order, text)], **options)
    return made.removeprefix(f"<body {NS}>").removesuffix("</body>"), done


@pytest.mark.parametrize(
    "given, kind, expected",
    [
        ("<choice><abbr>a$</abbr><expan>old</expan></choice>", "abbr", "<choice><abbr>a$</abbr><expan>E</expan></choice>"),
        ("<choice><abbr>a$</abbr></choice>", "abbr", "<choice><abbr>a$</abbr><expan>E</expan></choice>"),
        ("<p><abbr>a$</abbr> t</p>", "abbr", "<p><abbr>a$</abbr><expan>E</expan> t</p>"),
        (f"<p>ne{QUE} t</p>", "g", f"<p>ne<choice><abbr><am>{QUE}</am></abbr><expan><am>{QUE}</am><ex>E</ex></expan></choice> t</p>"),
        (f"<choice><abbr>n<am>{QUE}</am></abbr></choice>", "g", f"<choice><abbr>n<am>{QUE}</am></abbr><expan><am>{QUE}</am><ex>E</ex></expan></choice>"),
        (f"<p><abbr>n<am>{QUE}</am></abbr> t</p>", "g", f"<p><choice><abbr>n<am>{QUE}</am></abbr><expan><am>{QUE}</am><ex>E</ex></expan></choice> t</p>"),
        (f"<p><am>{QUE}</am> t</p>", "g", f"<p><am>{QUE}</am> t<expan>E</expan></p>"),
        (f"<p>lo{MACRON}</p>", "g", f"<p>lo{MACRON}<expan>E</expan></p>"),
        ("<choice><abbr>x<am>m</am></abbr><expan>old</expan></choice>", "am", "<choice><abbr>x<am>m</am></abbr><expan><am>m</am><ex>E</ex></expan></choice>"),
        ("<p><abbr>x<am>m</am></abbr></p>", "am", "<p><choice><abbr>x<am>m</am></abbr><expan><am>m</am><ex>E</ex></expan></choice></p>"),
        ("<p><am>m</am> t</p>", "am", "<p><am>m</am><expan>E</expan> t</p>"),
    ],
)
def test_expansions(given, kind, expected):
    assert expand(given, kind) == (expected, 1)


def test_expansion_options():
    assert expand("<p><abbr>a$</abbr> t</p>", "abbr", use_choice=True)[0] == "<p><choice><abbr>a$</abbr><expan>E</expan></choice> t</p>"
    assert expand("<p><abbr>a$</abbr> t</p>", "abbr", legacy_tail=True)[0] == "<p><abbr>a$</abbr> t<expan>E</expan></p>"
    made, _ = expand('<p><abbr xml:id="abbr_1">a$</abbr></p>', "abbr", add_ids=True)
    assert 'corresp="#abbr_1"' in made and 'xml:id="expan_' in made
    assert xmlpatch.patch("f", "<abbr/>", [(0, "x")]) == ("<abbr/>", 0)
    assert xmlpatch.patch("f", f"<p {NS}><abbr/></p>", [(9, "x")])[1] == 0
    assert "<p>\n" not in expand("<p>t<abbr>a</abbr></p>", "abbr", pretty=True)[0]


def test_scan_order_and_filters():
    found = scan(f"<p>a<abbr>b<am>{MACRON}</am></abbr><expan>c{MACRON}<am>d</am><abbr>e</abbr></expan><g ref='char:EOLhyphen'/></p>")
    assert [(k, n.content()) for k, _, n in found] == [("abbr", "b̄"), ("abbr", "e"), ("g", "̄"), ("am", "̄")]
    assert [n.path() for _, _, n in found][0] == "/TEI[1]/p[1]/abbr[1]"
    assert not tei.scan(parse("<TEI><abbr>x</abbr></TEI>"))
    assert all(k != "g" for k, _, _ in tei.scan(parse(f"<TEI {NS}><p>{MACRON}</p></TEI>"), with_g=False))


def test_forms_and_contexts():
    def one(body):
        return next(n for k, _, n in scan(body) if k == "g")

    assert tei.form_of_g(one(f"<p>preſent incu{MACRON}ming of <hi>the</hi> x</p>")) == ("preſent incu$ming of the x", "incu$ming")
    assert tei.form_of_g(one(f"<p>the con{MACRON} <hi>of</hi></p>")) == ("the con$of", "con$")
    assert tei.form_of_g(one(f"<p>{MACRON}abc</p>"))[0] == "m$abc"
    assert tei.form_of_g(one(f"<p>ne{QUE}</p>"))[0] == "neq$"
    assert tei.form_of_g(one(f"<p>{QUE}</p>"))[0] == "q$"
    a = next(n for k, _, n in scan("<p>one <hi>two</hi> three <abbr>x</abbr> four <hi>five</hi> six</p>"))
    assert tei.contexts(a) == ("three", "five")
    assert tei.word_contexts(a, 2, 2) == ("two three", "four five")
    b = next(n for _, _, n in scan("<p><abbr>x</abbr></p>"))
    assert tei.contexts(b) == ("", "")
    c = next(n for _, _, n in scan("<p>w v <hi><abbr>x</abbr></hi> u</p>"))
    assert tei.word_contexts(c) == ("w v", "u")


def test_already_expanded():
    state = lambda body: [tei.already_expanded(n) for _, _, n in scan(body)]
    assert state("<choice><abbr>a</abbr><expan>b</expan></choice>") == [True]
    assert state("<choice><abbr>a<am>m</am></abbr><expan>b</expan></choice>") == [True, True]
    assert state("<p><abbr>a</abbr> t <expan>b</expan></p>") == [True]
    assert state("<p><abbr>a</abbr><!-- c --><hi/><expan>b</expan></p>") == [False]


def test_metadata_and_poison(spark):
    header = '<teiHeader><fileDesc><titleStmt><title> T <hi>1</hi></title><title>2</title><author>A</author></titleStmt><sourceDesc><bibl>S</bibl><p><date>1650</date></p></sourceDesc></fileDesc><profileDesc><langUsage><language ident="eng"/></langUsage><textClass><term>x</term><term/><term>y</term><term>z</term></textClass></profileDesc></teiHeader>'
    good = f"<TEI {NS}>{header}<text><p>Kings m<abbr id='q'>co$</abbr> t</p></text></TEI>"
    rows = [("good", good), ("bad", good[:-5]), ("null", None), ("plain", "<root>Not a TEI document</root>"), ("empty", "")]
    scanned = tei.scan_documents(spark.createDataFrame(rows, "file_path string, xml string")).cache()
    by = {r["file_path"]: r for r in scanned.collect()}
    assert by["good"]["metadata"].asDict() == {"title": "T 1", "author": "A", "date": "1650", "language": "eng", "source": "S", "genre": "x, y"}
    assert by["good"]["valid_tei"] and not by["plain"]["valid_tei"] and by["plain"]["error"] is None
    assert all(by[k]["error"] for k in ("bad", "null", "empty"))
    found = tei.abbreviations(scanned).collect()
    assert [(r["abbr_id"], r["parent_tag"], r["normalized_form"], r["context_before"], r["context_after"], r["line_number"]) for r in found] == [("q", "p", "co$", "Kings m", "t", 1)]
    assert tei.statistics(scanned).first().asDict() == {"documents_processed": 2, "abbreviations_found": 1, "already_expanded": 0, "normalized_abbr": 0, "malformed_abbr": 3}


def test_patching_documents(spark):
    docs = spark.createDataFrame([("a", f"<p {NS}>x<abbr>y</abbr> z</p>"), ("b", "<p>"), ("c", "<p/>")], "file_path string, xml string")
    todo = spark.createDataFrame([("a", 0, 1, "E<"), ("a", 0, 1, "E<"), ("b", 0, 1, "E")], "file_path string, kind_ord int, node_ord int, expansion string")
    by = {r["file_path"]: r for r in xmlpatch.patch_documents(docs, todo, add_ids=False).collect()}
    assert by["a"]["xml"] == f"<p {NS}>x<abbr>y</abbr><expan>E&lt;</expan> z</p>" and by["a"]["expanded"] == 1
    assert by["b"]["xml"] == "<p>" and by["b"]["error"] and by["c"]["xml"] == "<p/>"


def test_round_trip_keeps_what_it_is_given():
    xml = '<t:a xmlns:t="u" k="1 &amp; &quot;2">x<!-- c --><?pi d?><t:b/>y &lt; z</t:a>'
    assert serialize(parse(xml)) == xml.replace('"1 &amp; &quot;2"', "'1 &amp; \"2'")
    assert serialize(parse("<a>\n <b/>\n</a>")) == "<a><b/></a>"
    assert serialize(parse("<a>t\n <b/>\n</a>")) == "<a>t\n <b/>\n</a>"
