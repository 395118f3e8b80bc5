from __future__ import annotations

import random

from pyspark.sql import functions as F

from vellum.llm import overlap as o
from vellum.llm import splits as s
from vellum.operators import sizes

ENTRY = "entry_no long, abbreviation string, context_before string, context_after string, source struct<file:string>, split string, genre string, label string"


def entry(no, abbr, file="f", before="", after="", split="train", genre=None):
    return (no, abbr, before, after, (file,), split, genre, "clash")


def frame(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def test_file_key(column):
    given = ["corpus/A_1.XML ", "C:\\x\\a_1.xml", "a_1", "x/../a_1.xml", "", None, "a/", " .xml", "a.xml.xml"]
    assert column(s.file_key, given) == ["a_1", "a_1", "a_1", "a_1", None, None, None, None, "a.xml"]


def test_tied_pairs(spark):
    rows = [entry(1, "Māner", "a"), entry(2, "ma\u0304ner", "x/B.xml"), entry(3, "q", "b"), entry(4, "q", "c"), entry(5, None, "d"), entry(6, "", "d"), entry(7, "q", None), entry(8, "alone", "e"), entry(8, "alone", "e"), entry(9, "\u200b", "a"), entry(10, "\u200b", "e")]
    got = sorted(tuple(r) for r in s.tied_pairs(frame(spark, rows)).collect())
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]
    assert s.tied_pairs(frame(spark, rows).limit(0)).count() == 0


def test_long_chains_and_hot_keys(spark):
    rng = random.Random(4)
    edges = [(f"f{i:03}", f"k{i}") for i in range(300)] + [(f"f{i + 1:03}", f"k{i}") for i in range(299)] + [(f"h{rng.randint(0, 300):03}", "hot") for _ in range(400)]
    edges += [(None, "k1"), ("zz", None)]
    rng.shuffle(edges)
    got = {r["file"]: r["label"] for r in s.propagate(spark.createDataFrame(edges, "file string, abbr string")).collect()}
    hot = sorted({f for f, k in edges if k == "hot"})
    assert {got[f] for f in hot} == {hot[0]} and {got[f"f{i:03}"] for i in range(300)} == {"f000"}
    assert set(got) == set(hot) | {f"f{i:03}" for i in range(300)}


def test_assignment(spark):
    rng = random.Random(5)
    rows = [entry(i, f"k{rng.randint(0, 900)}", f"f{rng.randint(0, 400)}" if i % 50 else None, genre=rng.choice(["x", "y", None])) for i in range(4000)]
    rows += [entry(10_000 + i, f"big{i}", "big", genre="y") for i in range(1500)]
    df = frame(spark, rows)
    got = s.assign_splits(df, F.col("genre"), buckets=64).collect()
    assert len(got) == len(rows) and all(r["new_split"] for r in got)
    by_group = {}
    for r in got:
        by_group.setdefault(r["tie_group"], set()).add(r["new_split"])
    assert all(len(v) == 1 for v in by_group.values())
    assert s.assign_splits(df.limit(0), F.col("genre")).count() == 0
    # Where groups are small, proportions hold overall and within each label.
    small = frame(spark, [entry(i, f"k{i}", f"f{i // 4}", genre="x" if i % 3 else "y") for i in range(6000)])
    parted = s.assign_splits(small, F.col("genre")).join(small.select("entry_no", "genre"), "entry_no").groupBy("genre", "new_split").count().collect()
    for r in parted:
        share = r["count"] / (4000 if r["genre"] == "x" else 2000)
        assert abs(share - {"train": 0.8, "validation": 0.1, "test": 0.1}[r["new_split"]]) < 0.01


def test_word_text_and_lcs():
    assert o.word_text(["Tēmpus, “est”\u200b / ｖerum; $ 12.", "", "\n"]) == ["tēmpus est verum 12", "", ""]
    rng = random.Random(6)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 80))] for _ in "ab")
        assert o.lcs(a, b) == plain(a, b)


def pairs(spark, rows):
    return sorted(tuple(r) for r in o.cross_split_pairs(frame(spark, rows)).collect())


def test_cases(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        entry(1, "Aā", before=text), entry(2, "aa\u0304", before=text.upper(), split="test"), entry(3, "aā", before=text.replace("three", "x").replace("nine", "y"), split="validation"),
        entry(4, "aā", before=text.replace("three", "x").replace("nine", "y").replace("one", "z"), split="test"), entry(5, "b", before=text, split="test"), entry(6, None, before=text), entry(7, None, before=text, split="test"),
        entry(8, "", before=text), entry(9, "c"), entry(10, "c", before=None, after=None, split=None), entry(10, "c", split=None), entry(11, "d", before="a b c d e"), entry(12, "d", after="a b c d e f", split="test"), entry(13, "d", before="a b c d x", split="test"),
    ]
    assert pairs(spark, rows) == [(1, 2), (1, 3), (9, 10), (11, 12)]
    assert pairs(spark, rows[:1]) == [] and o.cross_split_pairs(frame(spark, rows).limit(0)).count() == 0
    got = {r["entry_no"]: r["n_links"] for r in o.links(frame(spark, rows[:9])).collect()}
    assert got == {1: 2, 2: 1, 3: 1}
    assert {(r["split"], r["entries"], r["links"]) for r in o.report(frame(spark, rows[:9])).collect()} == {("train", 1, 2), ("test", 1, 1), ("validation", 1, 1)}


def test_against_all_pairs(spark):
    rng = random.Random(7)
    rows, no = [], 0
    for _ in range(60):
        base = [rng.choice("abcdefgh" if rng.random() < 0.5 else "a") for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 7, 11, 12, 13, 24, 36, 70]))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 5))):
                at = rng.randint(0, len(words))
                words[at : at + rng.randint(0, 1)] = rng.choice([[], ["z"], ["a"]])
            no += 1
            rows.append(entry(no, rng.choice(["k", "k", "m"]), before=" ".join(words[: len(words) // 2]), after=" ".join(words[len(words) // 2 :]), split=rng.choice(["train", "test", "validation"])))
    text = {r[0]: o.word_text([r[2] + " " + r[3]])[0].split(" ") for r in rows}
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[5] == "train" and b[5] != "train" and a[1] == b[1] and o.lcs(text[a[0]], text[b[0]]) >= o.needed(max(len(text[a[0]]), len(text[b[0]]))))
    assert len(want) > 500 and pairs(spark, rows) == want


def test_one_long_text(spark):
    words = " ".join(f"w{i % 977}" for i in range(5000))
    assert pairs(spark, [entry(1, "k", before=words), entry(2, "k", before=words.replace("w5 ", "x "), split="test")]) == [(1, 2)]


def test_hot_shingles_and_keys_are_parted(spark, monkeypatch):
    rng = random.Random(9)
    bases = [[rng.choice("abcdefghijklmn") for _ in range(12)] for _ in range(6)]
    rows = []
    for no in range(240):
        words = list(bases[no % 6])
        if no % 3:
            words[rng.randint(0, 11)] = rng.choice("xyz")
        rows.append(entry(no, rng.choice(["k", "k", "m"]), f"f{no % 7}" if no % 5 else None, before=" ".join(words), split=rng.choice(["train", "test"])))
    df = frame(spark, rows)
    plain, splits = pairs(spark, rows), sorted(map(tuple, s.assign_splits(df, F.col("genre")).collect()))
    tied = sorted(map(tuple, s.tied_pairs(df).collect()))
    assert len(plain) > 500 and len(tied) == 21 and len(set(plain)) == len(plain)
    _, found = o.classes(df)
    by_key = sorted(map(tuple, o.class_pairs(found).collect()))
    # The same with every shingle in parts, nothing taken for small, and groups in blocks.
    assert sorted(map(tuple, o.class_pairs(found, hot=(0, 2)).collect())) == by_key
    monkeypatch.setattr(sizes, "is_small", lambda df, *limits: False)
    assert pairs(spark, rows) == plain and sorted(map(tuple, s.tied_pairs(df, block=2).collect())) == tied
    assert sorted(map(tuple, s.assign_splits(df, F.col("genre")).collect())) == splits
