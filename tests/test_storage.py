from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vellum import storage
from vellum.operators import pick, sizes


def tables(spark):
    folder = storage.shared_dir(spark).removeprefix("file://")
    return {n for n in os.listdir(folder) if n.startswith("vellum-")}


def test_tables_go_with_their_scope(spark):
    before = tables(spark)
    with storage.scope():
        made = storage.materialize(spark.range(10))
        kept = storage.materialize(made.where("id > 3"))
        assert kept.count() == 6 and len(tables(spark) - before) == 2
        storage.release(made)
        assert len(tables(spark) - before) == 1
    assert tables(spark) == before


def test_counts_taken_while_writing(spark):
    with storage.scope():
        made, seen = storage.materialize_counted(spark.range(10), n=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
        assert made.count() == 10 and seen == {"n": 10, "odd": 5}
        assert storage.materialize_counted(spark.range(0), n=F.count("*"))[1] == {"n": 0}


@pytest.mark.parametrize("master, fine", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_no_folder_of_one_machine_on_a_cluster(master, fine):
    values = {}
    conf = SimpleNamespace(get=lambda k, d=None: values.get(k, d), set=values.__setitem__)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, setCheckpointDir=lambda p: None))
    if fine:
        assert storage.shared_dir(session).startswith("file:///")
    else:
        with pytest.raises(ValueError):
            storage.shared_dir(session)


def test_pick(spark):
    rows = [(1, "a", 5, "x"), (2, "a", 3, "y"), (3, "a", 3, "z"), (4, None, None, "n"), (5, None, 1, None), (6, "b", 2, "t"), (6, "b", 2, "t")]
    df = spark.createDataFrame(rows, "n int, key string, at int, other string").repartition(3)
    first = {r["key"]: r["at"] for r in pick.by_key(df, "key", ["at"]).collect()}
    assert first == {"a": 3, None: None, "b": 2} and pick.by_key(df, "key", ["at"]).count() == 3
    last = {r["key"]: (r["n"], r["first"]["at"]) for r in pick.by_key(df, "key", ["at"], last=True, first_order="first").collect()}
    assert last == {"a": (1, 3), None: (5, None), "b": (6, 2)}
    assert pick.by_key(df.limit(0), "key", ["at"]).count() == 0


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, monkeypatch, small, how):
    monkeypatch.setattr(sizes, "is_small", lambda df: small)
    many = spark.createDataFrame([(i, "hot" if i < 50 else f"k{i}" if i < 60 else None) for i in range(70)], "i int, k string")
    few = spark.createDataFrame([("hot", 1), ("k51", 2), ("k52", 3), ("none", 4)], "k string, v int")
    got = sorted(((r["i"], r["v"]) for r in sizes.spread_join(many, few, "k", "i", how, block=7).collect()), key=repr)
    assert got == sorted(((r["i"], r["v"]) for r in many.join(few, "k", how).collect()), key=repr) and len(got) == (52 if how == "inner" else 70)
