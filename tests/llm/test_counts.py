from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import frequency as f
from vellum.llm import packing as p
from vellum.llm import tokens as t


def plain_counts(rows, sigma):
    n, records = Counter(), defaultdict(set)
    for i, (field, terms) in enumerate(rows):
        terms = [x for x in terms or [] if x]
        for a in range(len(terms)):
            for k in range(1, sigma + 1):
                if a + k <= len(terms):
                    gram = (field, " ".join(terms[a : a + k]), k)
                    n[gram] += 1
                    records[gram].add(i)
    return {g: (n[g], len(records[g])) for g in n}


@pytest.mark.parametrize("sigma, hot", [(1, 10), (2, 3), (3, 100_000), (4, 2)])
def test_ngrams(spark, sigma, hot):
    rng = random.Random(sigma)
    rows = [(rng.choice("xy"), [rng.choice(["a", "a", "b", "c", "ab", "", None]) for _ in range(rng.randint(0, 9))]) for _ in range(200)] + [("x", None), ("x", []), ("y", ["a"] * 300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "field string, terms array<string>, term string").repartition(5)
    got = {(r["field"], r["term"], r["n"]): (r["occurrences"], r["records"]) for r in f.count_ngrams(df, sigma, hot).collect()}
    assert got == plain_counts(rows, sigma)
    assert f.count_ngrams(df.limit(0), sigma, hot).count() == 0


def test_marks_of_decisions(spark):
    rows = [(i, "Aā", "the man") for i in range(100)] + [(5, "Aā", "the man"), (200, "aa\u0304", "The\tmаn,"), (201, "q", "man."), (202, None, None), (203, " ", "x x ."), (None, "n", None), (None, "n", None), (204, "ok", None), (205, "ok", None), (206, "OK", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "decision_no long, abbreviation string, expansion string, field string")
    once = f.decisions_once(df)
    assert once.count() == 109
    counts = f.count_ngrams(f.decision_terms(once))
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in f.mark(counts, once.count(), common=20).collect()}
    assert got == {("abbreviation", "aā"): (101, 101, "common"), ("abbreviation", "q"): (1, 1, "rare"), ("abbreviation", "n"): (2, 2, "rare"), ("abbreviation", "ok"): (3, 3, None), ("expansion", "the"): (101, 101, "common"), ("expansion", "man"): (102, 102, "common"), ("expansion", "x"): (2, 1, "rare")}


def test_packing():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(rng.integers(5, 60))
        sizes = rng.integers(0, capacity + 1, int(rng.integers(0, 80)))
        where, n = p.best_fit_decreasing(sizes, capacity)
        fill = np.bincount(where, sizes, n) if len(sizes) else np.zeros(0)
        assert (fill <= capacity).all() and len(set(where.tolist())) == n
        assert -(-int(sizes.sum()) // capacity) <= p.lower_bound(sizes, capacity) <= max(n, int(len(sizes) > 0))


def test_bounds_are_bounds():
    # Against the least number of containers by search.
    def least(sizes, capacity):
        sizes = sorted((s for s in sizes if s), reverse=True)

        def fits(i, rooms):
            if i == len(sizes):
                return True
            for r in {r for r in rooms if r >= sizes[i]}:
                rest = list(rooms)
                rest[rest.index(r)] -= sizes[i]
                if fits(i + 1, rest):
                    return True
            return False

        n = 1
        while not fits(0, [capacity] * n):
            n += 1
        return n

    rng = np.random.default_rng(2)
    for _ in range(150):
        capacity = int(rng.integers(4, 25))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 8)))
        assert p.lower_bound(sizes, capacity) <= least(sizes.tolist(), capacity)
    assert p.lower_bound(np.array([6] * 5), 10) == 5


def test_pack_frames(spark):
    rng = random.Random(3)
    rows = [(i % 300, rng.randint(1, 400)) for i in range(900)] + [(1000, 2500), (1001, 1024), (1002, 2048), (1003, 0), (1004, None), (7, 10), (7, 10)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, n_tokens long, container string")
    got = p.pack(df, 1024, per_part=100).collect()
    fill, items = Counter(), defaultdict(list)
    for r in got:
        fill[r["container"]] += r["size"]
        items[r["doc_id"]].append((r["piece"], r["start"], r["size"]))
    assert max(fill.values()) <= 1024 and sum(fill.values()) == sum(n or 0 for _, n in rows)
    assert sorted(items[1000]) == [(0, 0, 1024), (1, 1024, 1024), (2, 2048, 452)] and sorted(items[1002]) == [(0, 0, 1024), (1, 1024, 1024)]
    assert items[1001] == [(0, 0, 1024)] and items[1003] == [(0, 0, 0)] and items[1004] == [(0, 0, 0)]
    assert sum(len(v) for k, v in items.items() if k < 300) == 902
    assert len(fill) <= 1.02 * sum(fill.values()) / 1024 + 10
    assert p.pack(df.limit(0)).count() == 0
    assert p.pack(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long")).count() == 1


def test_exchange_certifies(spark):
    # Partitions alone can't fill their last containers; together they can.
    rng = random.Random(11)
    rows = [(i, 0, rng.randint(1, 600)) for i in range(700)]
    items = spark.createDataFrame(rows, "row_id long, piece int, size long")
    found = p.pack_parts(items, 1024, per_part=70)
    parts = [df.select("part").distinct().count() for df, _ in found]
    assert len(found) > 2 and parts[0] < 9 and sum(parts[1:-1]) > 0 and parts[-1] <= 2
    got = [r for df, _ in found for r in df.collect()]
    assert sorted((r["row_id"], r["size"]) for r in got) == sorted((a, c) for a, _, c in rows)
    fill, alone = Counter(), Counter()
    for df, turn in found:
        for r in df.collect():
            fill[turn, r["part"], r["bin"]] += r["size"]
    for part in {r[0] for r in p.materialize(items).selectExpr("pmod(xxhash64(row_id, piece), 10)").distinct().collect()}:
        sizes = np.array([r["size"] for r in items.where(f"pmod(xxhash64(row_id, piece), 10) = {part}").collect()])
        alone[part] = p.best_fit_decreasing(sizes, 1024)[1]
    assert max(fill.values()) <= 1024 and len(fill) <= sum(alone.values()) and len(fill) <= 1 + -(-sum(fill.values()) // 1024) * 1.02


def test_exchange_of_two_partitions_closes_their_gap():
    import pandas as pd

    def part(n, sizes):
        where, bins = p.best_fit_decreasing(np.array(sizes), 10)
        return pd.DataFrame({"row_id": range(n * 100, n * 100 + len(sizes)), "piece": 0, "size": sizes, "part": n, "bin": where, "bins": bins, "bound": p.lower_bound(np.array(sizes), 10)})

    given = pd.concat([part(1, [6, 6, 6]), part(2, [4, 4, 4, 3])])
    assert given.groupby("part")["bins"].first().sum() == 5
    got = p._exchange(given, 10)
    assert got.groupby("part")["bins"].first().sum() == 4 and set(got["row_id"]) == set(given["row_id"])
    assert (got.groupby(["part", "bin"])["size"].sum() <= 10).all()
    one = p._exchange(part(3, [6, 5, 5]), 10)
    assert one["bins"].iloc[0] == 2


def test_empty_items_take_no_container(spark):
    df = spark.createDataFrame([(i, 0 if i % 2 else 700) for i in range(200)], "doc_id long, n_tokens long")
    report = p.fill_report(p.pack(df, per_part=30)).first()
    assert (report["items"], report["containers"]) == (200, 100)
    kept = p.kept_whole(p.pack(spark.createDataFrame([(1, 3000), (2, 0), (3, None), (4, 1024)], "doc_id long, n_tokens long"))).collect()
    assert sorted(tuple(r) for r in kept) == [(i, True, True) for i in (1, 2, 3, 4)]


VOCABULARY = t.DEFAULT_VOCABULARY


@pytest.fixture(scope="module")
def automaton():
    return t.load_automaton()


def test_tokens_against_the_public_tokenizer(spark, automaton):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(VOCABULARY)
    public.encode_special_tokens = True
    rng = random.Random(5)
    letters = "abe iou sthn\n 'slredvm.,-=  0123éſ̄$中🙂 \t<|>"
    texts = ["", "   ", "<|endoftext|>", "a" * 5000, "don't we'll I'M", "-" * 300, "\u2007\xa0 x\r\n\n y", "̃a\u200b½²٣"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = [(i, s, "clash") for i, s in enumerate(texts)] + [(-1, None, ""), (3, texts[3], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = t.encode(df)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert encoded.count() == len(rows) and got[-1] == [] and got[0] == []
    for i, s in enumerate(texts):
        assert got[i] == public.encode(s, add_special_tokens=False).ids, s
        assert automaton.decode(got[i]) == s
    assert {r["doc_id"]: r["text"] for r in t.decode(encoded).collect()}[6] == texts[6]
    counted = {r["doc_id"]: r["n_tokens"] for r in t.count_tokens(df).collect()}
    assert counted == {k: len(v) for k, v in got.items()}
    assert t.encode(df.limit(0)).count() == 0
    assert t.decode(spark.createDataFrame([(1, None), (2, []), (3, [10**6])], "doc_id long, ids array<int>")).where("text = ''").count() == 2


def test_table_of_transitions(automaton, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiosthnr $é") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    automaton._trie = None
    first = [automaton._path(w.encode()) for w in words]
    states, transitions = automaton.table_size()
    assert 0 < states <= transitions + 1 <= 1 + sum(len(w.encode()) for w in words)
    assert [automaton._path(w.encode()) for w in words] == first and automaton.table_size() == (states, transitions)
    monkeypatch.setattr(t, "MOST_STATES", 50)  # the table is begun anew over and over
    assert [automaton._path(w.encode()) for w in words] == first and automaton.table_size()[0] < states


def test_small_automata():
    def greedy(word, merges):
        parts = list(word)
        while True:
            ranked = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
            if not ranked:
                return parts
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(8)
    for _ in range(200):
        pieces, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 9)):
            pair = (rng.choice(pieces), rng.choice(pieces))
            if pair not in merges and pair[0] + pair[1] not in pieces:
                merges.append(pair)
                pieces.append(pair[0] + pair[1])
        number = {chr(b): b for b in range(256)}
        coded = []
        for u, v in merges:
            coded.append((number[u], number[v]))
            number[u + v] = 255 + len(coded)
        made = t.TokenAutomaton(list(range(256 + len(coded))), coded)
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [made.bytes[i].decode() for i in made.encode_word(word)] == greedy(word, merges), (word, merges)
