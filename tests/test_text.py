from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as t

STROKE = '<g ref="char:cmbAbbrStroke">̄</g>'


@pytest.mark.parametrize(
    "given, expected",
    [
        (f"Geraniu{STROKE}", "Geraniu$"), (f"d{STROKE}no{STROKE}", "d$no$"), (f"māgnus{STROKE}", "māgnus$"), (f"{STROKE}a", "a"), (f"ab{STROKE * 3}", "ab$"), ('ne<g ref="char:abque"/>', "neq$"),
        ("motiõ", "motio$"), ("nōn", "no$n"), ("ꝯtra", "con$tra"), ("n\u0304", "n$"), ("a\u0304", "a\u0304"), ("Ill.mo", "Ill$mo"), ("Ill.MO", "Ill.MO"), ("Ill.mos", "Ill.mos"), (".mo x", ".mo x"), ("", ""), (None, None),
    ],
)
def test_normalize(column, given, expected):
    assert column(t.normalize_abbreviation, [given]) == [expected]


def test_normalize_variants(column):
    assert column(lambda c: t.normalize_abbreviation(c, full_chain=True), [f"māgnus{STROKE}"]) == ["ma$gnus$"]
    assert column(t.basic_normalize, ["a\u0304", "ꝯtra", "motiõ", "Ill.mo", None]) == ["a$", "ꝯtra", "motio$", "Ill$mo", None]


def test_normalize_against_a_plain_model(column):
    rng = random.Random(3)
    letters = "abmn.oōõēꝑꝯᵉʳ ̄ꝗ$xyz"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(300)]

    def model(s):
        for a, b in t.MARKERS:
            s = s.replace(a, b)
        return re.sub(r"\.([a-z]{2})$", r"$\1", s)

    assert column(t.normalize_abbreviation, texts) == [model(s) for s in texts]


@pytest.mark.parametrize("given, expected", [("omnib;", ["omnibus"]), ("ideoq;", ["ideoque"]), ("xp;", ["xpre"]), ("q$", ["que"]), ("q$abc", ["queabc"]), ("aq$", []), ("āb;", ["ābus"]), ("̄b;", []), ("", [])])
def test_latin(column, given, expected):
    assert column(t.pattern_expansions, [given]) == [expected]


def test_other_patterns(column):
    assert column(lambda c: t.pattern_expansions(c, "english"), ["Dr x Dr", "x Dr", "Drake"]) == [["Doctor x Doctor"], [], []]
    assert column(lambda c: t.pattern_expansions(c, "greek"), ["omnib;"]) == [[]]
    own = [(rf"({t.WORD}+)\$({t.WORD}+)", ["$1n$2", "$1m$2"]), (rf"({t.WORD}+)õ(?=\n?\z)", ["$1on", "$1om"])]
    assert column(lambda c: t.pattern_expansions(c, patterns=own), ["co$cerning", "motiõ", "normal"]) == [["concerning", "comcerning"], ["motion", "motiom"], []]


def test_offline(column):
    assert column(t.offline_expansions, ["te$ting", "motiõ", "foõ", "iudgme$t", "abc", "", None]) == [["tenting"], ["motion"], ["foon"], ["judgment", "judgement"], ["abc"], [], []]


def test_lookup_key(spark):
    rows = [("n", "a", "x y"), ("", "a", "x"), (None, "", "x y "), ("", None, "  "), (None, None, None)]
    df = spark.createDataFrame(rows, "n string, a string, b string")
    assert [r[0] for r in df.select(t.lookup_key(F.col("n"), F.col("a"), F.col("b"))).collect()] == ["n", "a", "y", None, None]


def test_prompt_and_answer(spark, column):
    df = spark.createDataFrame([("a$", "b", None, ("lat", "T", None, "S")), ("a$", "", "", None)], "a string, b string, c string, m struct<language:string,title:string,date:string,source:string>")
    first, second = (r[0] for r in df.select(t.prompt(F.col("a"), F.col("b"), F.col("c"), F.col("m"))).collect())
    assert first.endswith("Additional information:\nLanguage: lat\nTitle: T\nDate: \nSource: S\n") and "exactly 3 distinct" in first
    assert second.endswith("Context before: \nContext after: \nAdditional information:\n")
    assert column(t.parse_answer, [" a, b ,, c\n", "", None]) == [["a", "b", "c"], [], None]


def test_display_and_ids(column):
    assert column(t.display_token, ["a b", "a b$ c", "a b c", ""]) == ["a b", "b$", "a b c", ""]
    assert column(lambda c: t.display_token(c, True), ["a b c", "x ā c"]) == ["...c", "ā"]
    assert column(t.truncate, ["x" * 50, "x" * 51]) == ["x" * 50, "x" * 47 + "..."]
    assert column(t.placeholder, ["co$cerning", None]) == ["concerning", None]
    assert column(lambda c: t.last_words(c, 2), ["a b c", "a", "", None]) == ["b c", "a", "", ""]
    assert column(lambda c: t.first_words(c, 2), ["a b c", " a", None]) == ["a b", "a", ""]
    assert column(lambda c: t.instruction("{abbr} {{x}} {context}", abbr=c, context=c), ["{context}"]) == ["{context} {x} {context}"]
