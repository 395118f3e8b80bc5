from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import language as n
from vellum.llm import subjects as s

WORDS = {
    "eng": "the and which that thereof window bridge maketh holdeth common people thinketh garden with upon unto shall".split(),
    "lat": "et quae non hoc ignis locus tempus memoria habet transit cum ex ad enim autem sunt domus".split(),
    "fra": "le les des vous avec nouveau jardin montagne tient prend sans dans leurs estoit fenestre feu".split(),
    "ita": "il della che sono questo giardino finestra buono tiene prende senza nella anche loro fuoco sotto".split(),
}


def text(rng, lang, k):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(k))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return n.fit([(lang, text(rng, lang, 15)) for lang in WORDS for _ in range(25)])


def test_labels(column):
    given = ["en", "English", "ENG", " lat ", "français", "fr-FR", "it; la", "und", "n/a", "", None, "?", "en_GB", "Latin and French"]
    assert column(n.named_languages, given) == [["eng"], ["eng"], ["eng"], ["lat"], ["fra"], ["fra"], ["lat", "ita"], [], [], [], [], [], ["eng"], ["lat", "fra"]]


def test_parts(spark, model):
    rng = random.Random(2)
    rows = [(1, text(rng, "eng", 9), None), (2, text(rng, "lat", 8) + ": " + text(rng, "fra", 9), ""), (3, text(rng, "ita", 7) + " " + text(rng, "eng", 10), " . ; 12"), (4, "xqzw wzzq qqxz zzwq wqxz zxqw", "Zzyzx"), (2, "", " ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "no long, a string, b string, lang string")
    got = sorted(tuple(r)[:5] for r in n.language_parts(df, "no", ["a", "b"], model).where("lang <> 'und'").collect())
    assert got == [(1, "a", 0, 9, "eng"), (2, "a", 0, 8, "lat"), (2, "a", 8, 9, "fra"), (3, "a", 0, 7, "ita"), (3, "a", 7, 10, "eng")]
    assert n.language_parts(df.limit(0), "no", ["a"], model).count() == 0
    carried = n.language_parts(df, "no", ["a"], model, ("lang",))
    assert carried.columns == ["no", "given_lang", "field", "first_word", "n_words", "lang", "confidence"]
    assert {r["given_lang"] for r in carried.collect()} == {"clash"}


def test_held_out_accuracy(model):
    rng = random.Random(3)
    given = [(lang, text(rng, lang, 8).split()) for lang in WORDS for _ in range(100)]
    found = n.detect(model, pa.array([w for _, w in given]))
    whole = [model.languages[k] if k >= 0 else "und" for k in found["lang"][np.unique(found["row"], return_index=True)[1]]]
    assert np.mean([a == b for a, (b, _) in zip(whole, given, strict=True)]) > 0.99
    long = n.detect(model, pa.array([text(rng, "eng", 30_000).split()]))
    assert long["words"].tolist() == [30_000] and model.languages[long["lang"][0]] == "eng"


def test_portions_cover_every_row_once():
    from vellum.llm.arrow import portions

    column = pa.array([["a"] * k for k in (0, 3, 9, 1, 0, 0, 2, 2, 50, 0)], pa.list_(pa.string()))
    for given in (column, column.slice(2, 6), column.slice(0, 0)):
        for most in (1, 4, 5, 1000):
            found = list(portions(given, most))
            assert [i for start, n in found for i in range(start, start + n)] == list(range(len(given)))
            assert all(n == 1 or sum(len(x) for x in given.slice(start, n).to_pylist()) <= most for start, n in found)


def test_foreign_texts_are_turned_away_and_own_ones_kept(model):
    rng = random.Random(12)
    for k in (4, 6, 12, 30):
        own = n.detect(model, pa.array([text(rng, lang, k).split() for lang in WORDS for _ in range(50)]))
        assert (own["lang"] >= 0).mean() > 0.98
        foreign = n.detect(model, pa.array([n._foreign(text(rng, lang, k).split(), i) for i in range(50) for lang in WORDS]))
        assert (foreign["lang"] < 0).mean() > 0.9 and (foreign["confidence"][foreign["lang"] < 0] == 0).all()
    assert (np.diff(model.least[1:7]) >= -0.05).all() and model.accepted(np.array([1.0, 0.0]), np.array([500, 500])).tolist() == [True, False]


def test_confidence_is_a_share_of_right_names(model):
    rng = random.Random(13)
    given = [(lang, (text(rng, lang, 2) + " " + text(rng, rng.choice(list(WORDS)), 1)).split()) for lang in WORDS for _ in range(200)]
    near = model.of_texts([w for _, w in given])
    right = np.array([model.languages[b] == lang for b, (lang, _) in zip(near.argmax(1), given, strict=True)])
    sure = model.confidence(near)
    assert ((sure > 0) & (sure <= 1)).all() and abs(sure.mean() - right.mean()) < 0.1
    assert right[sure > np.median(sure)].mean() >= right[sure <= np.median(sure)].mean()
    assert n.fit([("eng", "a b"), ("eng", "c d")]).confidence(np.array([[0.4]])).tolist() == [1.0]


def test_neighbours_in_one_language_are_joined(model, monkeypatch):
    rng = random.Random(7)
    lat, eng, fra = (text(rng, lang, 7).split() for lang in ("lat", "eng", "fra"))
    rows = pa.array([lat, eng + fra, [], lat[:3], lat[3:]])
    cuts = [3, 4, 3, 4, 2, 5, 3, 4]
    monkeypatch.setattr(n, "_course", lambda *_: np.repeat(np.arange(len(cuts)) % 2, cuts))
    found = n.detect(model, rows)
    assert [(r, f, w, model.languages[k]) for r, f, w, k in zip(found["row"], found["first"], found["words"], found["lang"], strict=True)] == [(0, 0, 7, "lat"), (1, 0, 7, "eng"), (1, 7, 7, "fra"), (3, 0, 3, "lat"), (4, 0, 4, "lat")]
    # A joined part has the confidence of the whole.
    monkeypatch.setattr(n, "_course", lambda *_: np.zeros(7, int))
    assert found["confidence"][0] == pytest.approx(n.detect(model, pa.array([lat]))["confidence"][0])


def test_unnamed_runs(spark, model):
    rng = random.Random(4)
    kind = "abbr_no long, context_before string, context_after string, metadata struct<language:string>"
    rows = [(1, text(rng, "lat", 8), text(rng, "eng", 5), ("en",)), (2, text(rng, "lat", 8) + "; " + text(rng, "ita", 7), text(rng, "eng", 6), ("Latin",)), (3, text(rng, "fra", 6), None, None), (4, text(rng, "fra", 6), "", ("fre",))]
    got = sorted(tuple(r) for r in n.unnamed_runs(spark.createDataFrame(rows, kind), model).collect())
    assert got == [(1, "context_before", "lat"), (2, "context_after", "eng"), (2, "context_before", "ita"), (3, "context_before", "fra")]


def test_fit_drops_wrong_labels(spark):
    rng = random.Random(5)
    samples = [(lang, text(rng, lang, 15)) for lang in WORDS for _ in range(10)]
    wrong = [("eng", text(rng, "lat", 15)) for _ in range(200)]
    model = n.fit(samples, wrong)
    found = n.detect(model, pa.array([text(rng, "lat", 10).split()]))
    assert model.languages[found["lang"][0]] == "lat"
    assert n.fit([("eng", "one two")]).languages == ["eng"]
    records = spark.createDataFrame([(i, lang, text(rng, lang, 15)) for i in range(20) for lang in WORDS] + [(99, None, None)], "no long, label string, text string")
    given = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(samples)] + [(100, None, "x")], "sample_id long, lang string, text string")
    assert n.fit_on(given, records, records["label"], records["text"], "no", per_language=5).languages == sorted(WORDS)


TOPICS = {1: "psalm grace soule bishop sinne prayer".split(), 2: "court warrant statute verdict tenant bond".split(), 3: "pulse herbe feuer bloud ague stomack".split()}
GENERAL = "the and which maketh people garden with common holdeth place window time".split()


def section(rng, subject, k=12):
    return " ".join(rng.choice(TOPICS[subject]) if subject and rng.random() < 0.4 else rng.choice(GENERAL) for _ in range(k)) + "."


def document(rng, subjects, k=6):
    return " ".join(section(rng, x) for x in subjects for _ in range(k))


def test_subjects(spark):
    rng = random.Random(6)
    terms = [(1, "psalm"), (1, "grace"), (2, "court"), (2, "warrant"), (3, "pulse"), (3, "herbe")]
    rows = [(i, document(rng, x), x) for i, x in enumerate([[rng.choice([0, 1, 2, 3])] if rng.random() < 0.8 else rng.sample([1, 2, 3], 2) for _ in range(400)])]
    kind = "doc_id long, text string, file_path string, source string, genre string, title string, share double"
    docs = spark.createDataFrame([(i, t, "corpus/x/a.xml", "s-press", "G", "T", 0.5) for i, t, _ in rows] + [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (902, " ", None, None, None, None, None), (1, rows[1][1], None, None, None, None, None)], kind)
    areas = spark.createDataFrame([(k,) for k in TOPICS], "subject_id long")
    labels = spark.createDataFrame([(i, k) for i, _, x in rows[:100] for k in x if k] + [(5, None), (None, 1)], "doc_id long, subject_id long")
    model = s.fit_on(docs, areas, spark.createDataFrame(terms, "subject_id long, term string"), labels)
    got = {}
    for r in s.subject_shares(docs, model).where("assigned").collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_id"])
    right = [got.get(i, set()) == {k for k in x if k} for i, _, x in rows]
    assert np.mean(right[100:]) > 0.95
    assert not {900, 901, 902} & set(got)
    assert s.subject_shares(docs.limit(0), model).count() == 0
    assert {r["subject_id"] for r in s.composition(docs, model, "genre").collect()} == {1, 2, 3}
    # A passing mention is no case.
    passing = document(rng, [1]) + " court " + document(rng, [1])
    found, _ = s.shares(model, pa.array([passing.split(), document(rng, [2], 2000).split()]))
    assert (found >= model.shares).tolist() == [[True, False, False], [False, True, False]]


def test_nothing_to_learn_from():
    assert (s.fit([], [], [], [1, 2]).shares == 0.25).all()
    model = s.fit([{"words": ["a", "b."]}], [], [], [1])
    found, _ = s.shares(model, pa.array([["a", "b."]]))
    assert found.tolist() == [[0.0]]
    rules = [{"words": "psalm grace psalm x y".split(), "genre": "Sermon"} for _ in range(20)] + [{"words": "p q r s t u v".split(), "genre": "Sermon"} for _ in range(5)]
    assert s.fit(rules, [(1, "psalm"), (2, "court")], [], [1, 2]).weights.any()
