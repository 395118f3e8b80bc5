from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.operators import decisions
from vellum.operators import dictionary as d
from vellum.operators import suggest as s
from vellum.sources.files import dictionary_frame

RECORD = "i int, normalized_form string, abbr_text string, context_before string, context_after string"


def lookup(spark, user, machine, key):
    frame = spark.createDataFrame([(key,)], "k string")
    return d.lookup(frame, "k", dictionary_frame(spark, user, machine)).first()["expansions"]


@pytest.mark.parametrize(
    "user, machine, key, expected",
    [
        ({"co$": ["con"]}, {"co$": ["con", "com"]}, "co$", ["con", "com"]),
        ({"Mr": ["Master", "Mister"]}, {}, "mr", ["Master", "Mister"]),
        ({"MR": ["A"], "Mr": ["Bb"]}, {"mR": ["Xx"]}, "mr", ["Xx"]),
        ({"MR": ["A"], "Mr": ["Bb"]}, {}, "mr", []),
        ({"x": ["aa", "aa"]}, {}, "x", ["aa", "aa"]),
        ({}, {}, "x", []),
        ({"x": ["aa"]}, {}, None, []),
    ],
)
def test_lookup(spark, user, machine, key, expected):
    assert lookup(spark, user, machine, key) == expected


def test_conflicts_and_resolution(spark):
    machine = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("yt", "that")], "abbr string, value string")
    user = spark.createDataFrame([("a", "x"), ("b", "Y"), ("d", "w"), ("yt", "it")], "abbr string, value string")
    assert [tuple(r) for r in d.conflicts(machine, user, ["yt"]).collect()] == [("b", "y", "Y")]
    for choice, m, u in (("M", "y", "y"), ("u", "Y", "Y"), ("S", "y", "Y")):
        new_m, new_u = d.resolve(machine, user, spark.createDataFrame([("b", choice), ("yt", "M")], "abbr string, choice string"), ["yt"])
        assert dict(new_m.collect())["b"] == m and dict(new_u.collect())["b"] == u and dict(new_u.collect())["yt"] == "it"


def test_merge_and_ascii(spark):
    a = spark.createDataFrame([("a", "x"), ("b", "y")], "abbr string, value string")
    b = spark.createDataFrame([("b", "z"), ("é", "q")], "abbr string, value string")
    assert dict(d.ascii_only(d.merge(a, b)).collect()) == {"a": "x", "b": "z"}


def test_add_custom(spark):
    old = spark.createDataFrame([("a", ["xx"]), ("n", None)], "abbr string, expansions array<string>")
    new = spark.createDataFrame([("a", " yy "), ("a", "xx"), ("b", "zz"), ("c", "z"), (None, "qq"), ("d", None)], "abbr string, expansion string")
    assert {r[0]: r[1] for r in d.add_custom(old, new).collect()} == {"a": ["xx", "yy"], "b": ["zz"], "n": []}


def test_cascade(spark):
    words = dictionary_frame(spark, {"omnib;": ["omnibus", "Omnibus"], "a": ["x"]}, {})
    rows = [(0, "omnib;", "", "", ""), (1, "ideoq;", "", "", ""), (2, "te$t", "", "", ""), (3, "", "", "", ""), (4, "a", "", "", "")]
    records = spark.createDataFrame(rows, RECORD)
    lemmas = spark.createDataFrame([("apple",), ("ant",), ("a",), ("arm",), ("axe",), (None,)], "lemma string")
    found = s.suggestions(records, words, lemmas=lemmas)
    got = {}
    for r in s.ranked(found, "i").orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append((r["expansion"], r["confidence"], r["source"]))
    assert got[0] == [("omnibus", 0.8, "dictionary"), ("Omnibus", 0.8, "dictionary")]
    assert got[1] == [("ideoque", 0.4, "pattern")]
    assert got[2] == [("tent", 0.8, "language_model")]
    assert 3 not in got
    assert [x[0] for x in got[4]] == ["ant", "apple", "arm"]
    counts = s.statistics(found).first().asDict()
    assert counts == {"total_suggestions": 5, "dictionary_matches": 1, "pattern_matches": 1, "wordnet_suggestions": 1, "lm_suggestions": 1, "failed_abbreviations": 1}
    assert s.statistics(found.limit(0)).first()["pattern_matches"] == 0


def test_provider_sees_unresolved_rows_only(spark):
    class Echo:
        def answer(self, prompts):
            return [None if "te$t" in p else "one, two ,," for p in prompts]

    records = spark.createDataFrame([(0, "omnib;", "", "", ""), (1, "zz", "", "", ""), (2, "te$t", "", "", "")], RECORD)
    found = s.suggestions(records, dictionary_frame(spark, {}, {}), provider=Echo())
    got = sorted((r["i"], r["expansion"]) for r in s.ranked(found, "i").collect())
    assert got == [(0, "omnibus"), (1, "one"), (1, "two"), (2, "tent")]


def test_ranking_and_choices(spark):
    kind = "i int, suggestions array<struct<expansion:string,confidence:double,source:string>>"
    given = [(0, [("first", 0.5, "a"), ("second", 0.9, "b"), ("third", 0.7, "c"), ("fourth", 0.9, "d"), ("none", None, "e")]), (1, []), (2, [("x", 0.4, "p")])]
    df = spark.createDataFrame(given, kind)
    assert [r["expansion"] for r in s.ranked(df, "i").where("i = 0").orderBy("rank").collect()] == ["second", "fourth", "third", "first", "none"]
    assert [r["expansion"] for r in s.ranked(s.without_single_letters(df), "i").where("i = 2").collect()] == ["x"]
    assert s.ranked(s.without_single_letters(df, always=True), "i").where("i = 2").count() == 0
    choices = spark.createDataFrame([(0, 2, None), (1, 1, " own "), (2, 9, "z")], "i int, choice int, custom string")
    assert sorted(tuple(r) for r in s.choose(df, choices, "i").collect()) == [(0, "fourth", 0.9, "d"), (1, "own", 1.0, "custom")]


def test_last_decision_wins_at_first_place(spark):
    rows = [(1, "k", None, "a"), (2, "k", None, "b"), (3, "", "n", "c"), (4, None, None, "d")]
    df = spark.createDataFrame(rows, "at int, abbr_text string, normalized_form string, expansion string")
    got = {r["abbr_key"]: (r["expansion"], r["first_at"]) for r in decisions.best_decisions(df, "at").collect()}
    assert got == {"k": ("b", 1), "n": ("c", 3), "unknown_4": ("d", 4)}
    assert decisions.best_decisions(df.limit(0), "at").count() == 0


def test_large_dictionaries_are_not_broadcast(spark):
    from vellum.operators.sizes import broadcast_if_small

    df = spark.range(50).withColumn("x", F.lit(1))
    assert "broadcast" in broadcast_if_small(df, 50)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, 49)._jdf.queryExecution().logical().toString().lower()
