from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.operators import dataset as d
from vellum.operators import replace as r
from vellum.sources import sinks

ENTRY = "at int, id string, abbreviation string, context_before string, context_after string"


@pytest.mark.parametrize("n, train, validation", [(0, 0, 0), (1, 0, 0), (3, 2, 0), (7, 5, 0), (9, 7, 0), (10, 8, 1), (11, 8, 1), (100, 80, 10), (105, 84, 10)])
def test_split_sizes(spark, n, train, validation):
    df = spark.range(n)
    got = {x["split"]: x["n"] for x in d.split_counts(d.split(df, F.col("id").cast("string"))).collect()}
    assert (got.get("train", 0), got.get("validation", 0), got.get("test", 0)) == (train, validation, n - train - validation)


def test_split_is_disjoint_and_stratified(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 100, "a").when(F.col("id") < 190, "b").alias("k"))
    got = d.split(df, F.col("id").cast("string"), stratify_by="k")
    assert got.count() == 200 and got.select("id").distinct().count() == 200
    per = {(x["k"], x["split"]): x["count"] for x in got.groupBy("k", "split").count().collect()}
    assert per["a", "train"] == 80 and per["b", "train"] == 72 and per[None, "train"] == 8
    plain = d.split(df, F.col("id").cast("string"), stratify_by="missing")
    assert d.split_counts(plain).where("split = 'train'").first()["n"] == 160


def test_shuffled_split_follows_the_generator(spark):
    order = list(range(100))
    random.Random(42).shuffle(order)
    got = {x["id"]: x["split"] for x in d.split_shuffled(spark.range(100), "id").collect()}
    assert {i for i, s in got.items() if s == "train"} == set(order[:80]) and {i for i, s in got.items() if s == "validation"} == set(order[80:90])
    with pytest.raises(ValueError):
        d.split_shuffled(spark.range(10), "id", most=9)


def _shuffled(values, train=0.8, validation=0.1, seed=42):
    """The split of each of ``values`` by Python's shuffle; values without order come last."""
    order = sorted(values, key=lambda v: (v is None, v))
    random.Random(seed).shuffle(order)
    a = math.floor(len(order) * train)
    b = a + math.floor(len(order) * validation)
    return Counter((v, "train" if i < a else "validation" if i < b else "test") for i, v in enumerate(order))


def test_shuffled_split_has_no_most_rows_unless_given(spark):
    n = 1_000_001
    order = list(range(n))
    random.Random(42).shuffle(order)
    got = d.split_shuffled(spark.range(n), "id").cache()
    assert got.columns == ["id", "split"] and got.count() == n and got.select("id").distinct().count() == n
    rest = {s: set(got.where(F.col("split") == s).toArrow()["id"].to_pylist()) for s in ("validation", "test")}
    got.unpersist()
    assert rest["validation"] == set(order[800_000:900_000]) and rest["test"] == set(order[900_000:])


def test_parts_of_places_are_those_of_the_generator():
    for n in (0, 1, 2, 31, 32, 33, 1000):
        for trained, validated in {(0, 0), (0, n), (n, n), (n // 3, n // 2), (n * 4 // 5, n * 9 // 10)}:
            order = list(range(n))
            random.Random(7).shuffle(order)
            words = [w for batch in d._shuffled_parts(n, trained, validated, 7) for w in batch.column(1).to_pylist()]
            ranks = {p: k for k, p in enumerate(order)}
            assert [words[p // 32] >> p % 32 * 2 & 3 for p in range(n)] == [(ranks[p] >= trained) + (ranks[p] >= validated) for p in range(n)]


@pytest.mark.parametrize("sent, n", [(True, 1002), (False, 1002), (True, 33), (True, 0)])
def test_shuffled_split_of_gaps_ties_and_nulls(spark, monkeypatch, sent, n):
    if not sent:
        monkeypatch.setattr(d, "broadcast_if_small", lambda words: words)
    values = ([-5, 2**60] + [7 * (i % 301) if i % 50 else None for i in range(1000)])[:n]
    rows = spark.createDataFrame([(v,) for v in values], "k long").repartition(5)
    assert Counter(map(tuple, d.split_shuffled(rows, "k", 0.34, 0.6, 7).collect())) == _shuffled(values, 0.34, 0.6, 7)


def test_validation(spark):
    rows = [(0, "entry_1", "co$cerning", "b", "a"), (1, "entry_1", "other", "b", "a"), (2, None, "no_id", "b", "a"), (3, None, "again", "b", "a"), (4, "entry_4", None, "b", "a"), (5, "entry_4", "late", None, None)]
    df = spark.createDataFrame(rows, ENTRY)
    assert sorted(x["abbreviation"] for x in d.validate(df, "at").collect()) == ["co$cerning", "late", "no_id"]
    assert d.validate(df, "at", check_duplicates=False).count() == 5
    assert d.validation_counts(df).first().asDict() == {"total_entries": 6, "skipped_entries": 1, "duplicate_entries": 2}
    assert d.validate(df.limit(0), "at").count() == 0


def test_entries(spark):
    kind = "abbr_text string, abbr_id string, file_path string, xpath string, line_number int, context_before string, context_after string, metadata struct<title:string>"
    df = spark.createDataFrame([("a$", "i", "f", "/x", 3, "Context before", "Context after", ("t",)), ("b$", None, "f", "/y", None, "x" * 20, None, None)], kind)
    assert [x["abbreviation"] for x in d.entries(df).collect()] == ["b$"]
    both = d.entries(df, "combined", include_metadata=False, min_context=0).collect()
    assert both[0].asDict(True) == {"abbreviation": "a$", "id": "i", "context": "Context before a$ Context after", "source": {"file": "f", "xpath": "/x", "line": 3}}
    assert both[1]["context"] == "x" * 20 + " b$ " and both[1]["id"].startswith("abbr_")


def test_chat(spark):
    df = spark.createDataFrame([(0, "i", "co$cerning", "b {abbr}", "a")], ENTRY)
    said = df.select(d.chat_messages(df, "sys").alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in said] == [("system", "sys"), ("user", "Expand the abbreviation: co$cerning in context: b {abbr} co$cerning a"), ("assistant", "concerning")]
    own = spark.createDataFrame([("argume$t", "given")], "abbreviation string, context string")
    said = own.select(d.chat_messages(own).alias("m")).first()["m"]
    assert [m["content"] for m in said] == ["Expand the abbreviation: argume$t in context: given", "argument"]


def test_saving(spark, tmp_path):
    df = spark.createDataFrame([(0, "ā"), (1, 'q"')], "i int, x string")
    assert sinks.save_array(df, str(tmp_path / "deep/a.json"), "i")
    assert json.loads((tmp_path / "deep/a.json").read_text()) == [{"i": 0, "x": "ā"}, {"i": 1, "x": 'q"'}]
    assert sinks.save_dataset(df, str(tmp_path / "lines"), "JSONL") and spark.read.json(str(tmp_path / "lines")).count() == 2
    assert sinks.save_array(df.limit(0), str(tmp_path / "none.json")) and json.loads((tmp_path / "none.json").read_text()) == []
    assert sinks.update_json(tmp_path / "u.json", {"a": 1}) and sinks.update_json(tmp_path / "u.json", {"b": 2})
    assert json.loads((tmp_path / "u.json").read_text()) == {"a": 1, "b": 2}
    assert not sinks.write_atomic("/proc/no/such", ["x"])
    with pytest.raises(ValueError):
        sinks.save_dataset(df, str(tmp_path / "x"), "csv")


def test_replacement(spark):
    files = spark.createDataFrame([("f", "abcab ē.mo\r\nzz\n"), ("g", ""), ("h", None)], "file_name string, text string")
    done = r.run(files, r.steps(["a"], {"b": "c"})).cache()
    got = {(x["file_name"], x["line_number"]): x["line"] for x in done.collect()}
    assert got == {("f", 1): "ccc e$.mo", ("f", 2): "zz"}
    log = r.change_log(done)
    assert [(x["original"], x["replacement"]) for x in log.orderBy("step").collect()] == [("a", "deleted"), ("b", "c"), ("ē", "e$"), (".mo", ".mo")]
    assert r.summary(log).first().asDict() == {"deleted": 1, "replaced": 3, "files": 1}
    assert {x["file_name"]: x["text"] for x in r.whole_texts(done).collect()} == {"f": "ccc e$.mo\nzz\n"}
    assert r.run(files, r.steps(["a"]), on=False).where("line_number = 1").first()["line"] == "abcab ē.mo"
