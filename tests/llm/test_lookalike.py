from __future__ import annotations

import random
import unicodedata

import pytest

from vellum.llm import lookalike as k


@pytest.mark.parametrize(
    "a, b, alike",
    [
        ("ｍaneｒ", "maner", True), ("māner", "ma\u0304ner", True), ("māner", "mãner", False), ("mãner", "maner", False), ("ſir", "sir", False), ("yᵉ", "ye", False), ("Mr", "mr", False),
        ("\u200bco\xadurt\xa0", "court", True), ("yᵉ\u2007court", "yᵉ court", True), ("ꝓﬁt", "ꝓfit", True), ("оffiсе", "office", True), ("Μr", "Mr", True), ("﹩", "$", True), ("ç", "c\u0327", True), ("ç", "c", False),
        ("", "\u200b ", True), ("a b", "ab", False), ("ꝑ", "p", False), ("ﬅ", "ſt", True), ("æ", "ae", False),
    ],
)
def test_alike(a, b, alike):
    assert (k.skeleton(a) == k.skeleton(b)) is alike
    assert k.skeletons([a, b]) == [k.skeleton(a), k.skeleton(b)]


def test_reading():
    assert [k.reading(s) for s in k.skeletons(["MĀNER", "rofireguνifuꝑ", "πνα", "καὶ", "İ"])] == ["māner", "rofireguvifuꝑ", "πνα", "καὶ", "i\u0307"]
    assert k.skeletons(["a\ue000b", "ｃ"]) == ["a\ue000b", "c"] and k.skeletons([]) == [] and k.skeleton(None) is None


def test_skeleton_is_stable():
    rng = random.Random(2)
    for _ in range(500):
        s = "".join(chr(rng.choice([rng.randint(0x20, 0x24F), rng.randint(0x300, 0x5FF), rng.randint(0xFB00, 0xFFEF)])) for _ in range(8))
        once = k.skeleton(s)
        assert k.skeleton(once) == once and k.skeleton(unicodedata.normalize("NFC", s)) == once


def test_find(spark):
    forms = spark.createDataFrame([(1, "māner"), (2, "co$t"), (3, None), (4, "māner"), (5, "yᵉ x")], "form_id long, form string")
    rows = [(1, "ma\u0304ner", "co$t"), (2, "māner", "co＄t"), (3, None, ""), (4, "mãner", " co$t"), (5, "x" * 100_000, "  "), (5, "yᵉ\xa0x", "yᵉ x")]
    texts = spark.createDataFrame([(*r, "clash") for r in rows], "no long, a string, b string, form string")
    got = sorted(tuple(r) for r in k.find_lookalikes(texts, forms, ["no"], ["a", "b"]).collect())
    assert got == [(1, "a", 1), (1, "a", 4), (2, "b", 2), (4, "b", 2), (5, "a", 5)]
    assert sorted(tuple(r) for r in k.find_lookalikes(texts, forms, ["no"], ["a", "b"], max_forms=1).collect()) == got
    assert k.find_lookalikes(texts.limit(0), forms, ["no"], ["a"]).count() == 0 and k.find_lookalikes(texts, forms.limit(0), ["no"], ["a"]).count() == 0
    # A form that isn't plain may look like plain texts.
    wide = spark.createDataFrame([(9, "ｃo$t")], "form_id long, form string")
    assert [tuple(r) for r in k.find_lookalikes(texts, wide, ["no"], ["b"]).where("no = 1").collect()] == [(1, "b", 9)]


def test_find_before_line_ends(spark):
    forms = spark.createDataFrame([(1, "co$t"), (2, "sir\n")], "form_id long, form string")
    ends = ["\n", "\r\n", "\r", "\x85", "\u2028", "\u2029", "\n\n", " ", "\t"]
    texts = spark.createDataFrame([(0, "co$t"), *((i, "co$t" + e) for i, e in enumerate(ends, 1)), (20, "sir"), (21, "sir\n")], "no long, a string")
    got = sorted(tuple(r) for r in k.find_lookalikes(texts, forms.where("form_id = 1"), ["no"], ["a"]).collect())
    assert got == [(i, "a", 1) for i in range(1, len(ends) + 1)]
    # A form with a line end isn't plain, so plain values may look like it.
    assert [tuple(r) for r in k.find_lookalikes(texts, forms.where("form_id = 2"), ["no"], ["a"]).collect()] == [(20, "a", 2)]


def test_every_blank_at_either_end(spark):
    # The same as skeletons of all values, without any filter before.
    rng = random.Random(3)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cf", "Cc")]
    values = [b + "co$t" for b in blanks] + ["co$t" + b for b in blanks] + ["co" + b + "$t" for b in blanks]
    values += ["".join(rng.choice(["c", "o", "$", "t", "ｃ", "о", " ", "\n", "\u200b", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(500)]
    forms = spark.createDataFrame([(1, "co$t"), (2, "x"), (3, "t o")], "form_id long, form string")
    texts = spark.createDataFrame(list(enumerate(values)), "no long, a string")
    looks = {k.skeleton(f): i for i, f in ((1, "co$t"), (2, "x"), (3, "t o"))}
    want = sorted((i, "a", looks[k.skeleton(v)]) for i, v in enumerate(values) if k.skeleton(v) in looks and v not in ("co$t", "x", "t o"))
    assert len(want) > 100 and sorted(tuple(r) for r in k.find_lookalikes(texts, forms, ["no"], ["a"]).collect()) == want


def test_table_of_look_alikes():
    assert k.skeletons(["ᏢᎠᏟ", "ꓟꓴꓢ", "ⲟⲣⲥ", "ᴠᴏx"]) == ["PDC", "MUS", "opc", "vox"]
    assert all(k._PROTOTYPES[ord(b)] == b for _, right in k._ALIKE for b in right)


def test_groups(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "ａ", "z"), (3, "a", "a"), (4, "b", "ａ"), (5, None, None)], "no long, x string, field string")
    got = sorted(tuple(r) for r in k.groups_by_look(df, ["x", "field"], "no").collect())
    assert got == [("field", "a", 1, 3, 2), ("field", "ａ", 1, 4, 2), ("x", "a", 2, 1, 2), ("x", "ａ", 1, 2, 2)]
