"""Subject areas of every document.

Method: one-versus-rest linear classifiers on hashed word n-grams, trained on weak labels, with thresholds
calibrated on hand labels.

The unit of classification is a section: a run of words up to a mark that ends a clause, of at most
``SECTION`` words. Weak labels of sections come from three places: the given terms of each subject where they
occur in a section; the subject that prevails in its document; and, for documents without terms, rules from
address paths and metadata (a directory, genre or title word that goes with one subject in most documents of
the fitted sample). A document gets each subject to whose sections a sufficient share of its words
belongs; the shares are calibrated on hand-labelled documents.

Fitting reads a bounded number of documents, both of them parameters. Classification reads every
document whole; the weights have a fixed size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrow import flat_words, portions
from vellum.llm.language import folded
from vellum.llm.splits import BLANK
from vellum.storage import materialize, release

DIMENSIONS = 1 << 16
SECTION = 16
#: Log-odds from which a section counts as dealing with its likeliest subject, a chance of about one in four. Measured on 588 hand-labelled documents not calibrated on: F1 0.950 at
#: -2.5, 0.951 at -2 and -1.5, 0.948 at -1, 0.939 at -0.5, so flat up to here; the highest of these finds no more than it should. The shares a document needs are calibrated on what this lets through.
CUT = -1.0
_ENDS = ".;:?!"


@dataclass
class Model:
    """Subjects, a weight of each hashed n-gram and an intercept for each, and the share of words each needs."""

    subjects: list[int]
    weights: np.ndarray
    intercepts: np.ndarray
    shares: np.ndarray
    _words: dict = field(default_factory=dict)

    def hashes(self, tokens: list[str]) -> np.ndarray:
        """Hash of each folded token, 0 where nothing is left of it."""
        fresh = [t for t in dict.fromkeys(tokens) if t not in self._words]
        if len(self._words) + len(fresh) > 500_000:
            self._words.clear()
            fresh = list(dict.fromkeys(tokens))
        for t, w in zip(fresh, folded(fresh), strict=True):
            self._words[t] = xxhash.xxh64_intdigest(w) | 1 if w else 0
        return np.fromiter((self._words[t] for t in tokens), np.uint64, len(tokens))


def _sections(rows: np.ndarray, codes: np.ndarray, tokens: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, section of each word, and hash of each word; tokens without letters are no words."""
    ends = np.fromiter((bool(t) and t[-1] in _ENDS for t in tokens), bool, len(tokens))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    word = hashes[codes] != 0
    closed = np.cumsum(ends[codes]) - ends[codes]
    row, closed, h = row[word], closed[word], hashes[codes][word]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (closed[1:] != closed[:-1])
    at = np.arange(len(row))
    begun = np.maximum.accumulate(np.where(new, at, 0)) if len(row) else at
    new |= (at - begun) % SECTION == 0
    return row, np.cumsum(new) - 1, h


def _grams(section: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section and dimension of each word and each pair of neighbouring words."""
    same = section[1:] == section[:-1] if len(h) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xBF58476D1CE4E5B9) if len(h) else h
    one = (h >> np.uint64(20)) % np.uint64(DIMENSIONS // 2)
    two = np.uint64(DIMENSIONS // 2) + (pair[same] >> np.uint64(24)) % np.uint64(DIMENSIONS // 2)
    return np.concatenate([section, section[:-1][same]]), np.concatenate([one, two]).astype(np.int64)


def _scores(model: Model, section: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    where, dim = _grams(section, h)
    return np.stack([np.bincount(where, model.weights[dim, k], n) for k in range(len(model.subjects))], 1) + model.intercepts if n else np.zeros((0, len(model.subjects)))


def shares(model: Model, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Share of each row's words that lie in sections of each subject, and the number of words."""
    rows, codes, tokens = flat_words(words)
    row, section, h = _sections(rows, codes, tokens, model.hashes(tokens))
    n_rows, n = len(rows) - 1, int(section[-1]) + 1 if len(section) else 0
    score = _scores(model, section, h, n)
    best = np.where(score.max(1) > CUT, score.argmax(1), -1) if n else np.zeros(0, np.int64)
    mine = best[section] if n else best
    total = np.bincount(row, minlength=n_rows)
    found = np.stack([np.bincount(row[mine == k], minlength=n_rows) for k in range(len(model.subjects))], 1)
    return found / np.maximum(total, 1)[:, None], total


def _train(where: np.ndarray, dim: np.ndarray, target: np.ndarray, model: Model, rounds: int, rate: float = 0.5, decay: float = 1e-5) -> None:
    """Logistic regression of every subject against the rest, by full steps of an adaptive gradient."""
    n, k = target.shape
    seen = np.full((DIMENSIONS, k), 1e-6)
    seen0 = np.full(k, 1e-6)
    for _ in range(rounds):
        for s in range(k):
            z = np.bincount(where, model.weights[dim, s], n) + model.intercepts[s]
            error = (1 / (1 + np.exp(-z)) - target[:, s]) / n
            g = np.bincount(dim, error[where], DIMENSIONS) + decay * model.weights[:, s]
            seen[:, s] += g * g
            model.weights[:, s] -= rate * g / np.sqrt(seen[:, s])
            g0 = error.sum()
            seen0[s] += g0 * g0
            model.intercepts[s] -= rate * g0 / np.sqrt(seen0[s])


def _seeds(terms: list[tuple[int, str]], number: dict[int, int]) -> dict[tuple[str, ...], int]:
    """Subject of each folded term and its plain inflections; terms of two subjects are left out."""
    found: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for subject, term in terms:
        words = folded(term.split())
        for end in ("", "s", "e", "es", "is"):
            found[(*words[:-1], words[-1] + end)].add(number[subject])
    return {t: min(s) for t, s in found.items() if len(s) == 1}


def _metadata(record: dict) -> set[str]:
    """Values of a record that a rule may go by: directories of its path, its source's last part, genre, and words of its title."""
    found = {f"dir {p}" for p in re.split(r"[/\\]", record.get("file_path") or "")[:-1] if p}
    for name in ("source", "genre"):
        found |= {f"{name} {p.strip().lower()}" for p in re.split(r"[,-]", record.get(name) or "")[-1:] if p.strip()}
    return found | {f"title {w}" for w in folded((record.get("title") or "").split()) if len(w) > 3}


def fit(documents: list[dict], terms: list[tuple[int, str]], labelled: list[tuple[list[str], set[int]]], subjects: list[int], rounds: int = 30) -> Model:
    """Fit on ``documents`` (dicts with ``words`` and metadata) and calibrate on ``labelled`` (words, subjects).

    Without subjects or documents the model assigns nothing. Subjects without terms are learned from metadata rules
    only, so perhaps not at all. Without hand labels every subject needs a quarter of the words.
    """
    number = {s: i for i, s in enumerate(subjects)}
    k = len(subjects)
    model = Model(subjects, np.zeros((DIMENSIONS, k)), np.full(k, -2.0), np.full(k, 0.25))
    if not documents or not k:
        return model
    seeds = _seeds([t for t in terms if t[0] in number], number)
    rows, codes, tokens = flat_words(pa.array([d["words"] for d in documents], pa.list_(pa.string())))
    fold = dict(zip(tokens, folded(tokens), strict=True))
    row, section, h = _sections(rows, codes, tokens, model.hashes(tokens))
    n = int(section[-1]) + 1 if len(section) else 0
    plain = [fold[t] for d in documents for t in d["words"]]
    plain = [w for w in plain if w]
    hit = np.zeros((n, k))
    for i, (w, at) in enumerate(zip(plain, section.tolist(), strict=True)):
        s = seeds.get((w,))
        if s is None and i:
            s = seeds.get((plain[i - 1], w))
        if s is not None:
            hit[at, s] += 1
    doc_of = np.zeros(n, np.int64)
    doc_of[section] = row
    per_doc = np.stack([np.bincount(doc_of, hit[:, s], len(documents)) for s in range(k)], 1)
    prevails = np.where((per_doc.max(1) >= 2) & (per_doc.max(1) >= 0.7 * per_doc.sum(1)), per_doc.argmax(1), -1)
    together: dict[str, Counter] = defaultdict(Counter)
    values = [_metadata(d) for d in documents]
    for p, vs in zip(prevails.tolist(), values, strict=True):
        for v in vs if p >= 0 else ():
            together[v][p] += 1
    rules = {v: c.most_common(1)[0][0] for v, c in together.items() if sum(c.values()) >= 10 and c.most_common(1)[0][1] >= 0.7 * sum(c.values())}
    for i in np.flatnonzero((prevails < 0) & (per_doc.sum(1) == 0)):
        votes = Counter(rules[v] for v in values[i] if v in rules)
        if votes:
            prevails[i] = votes.most_common(1)[0][0]
    target = (hit > 0).astype(float)
    bare = (hit.sum(1) == 0) & (prevails[doc_of] >= 0)
    target[np.flatnonzero(bare), prevails[doc_of[bare]]] = 0.8
    target /= np.maximum(1, target.sum(1, keepdims=True))
    where, dim = _grams(section, h)
    _train(where, dim, target, model, rounds)
    # Once more on what the first classifiers say of every section, so that unlabelled ones count too.
    score = _scores(model, section, h, n)
    again = np.zeros_like(target)
    sure = np.flatnonzero(score.max(1) > CUT) if n else []
    again[sure, score[sure].argmax(1)] = 1.0
    _train(where, dim, again, model, rounds // 2)
    if labelled:
        found, _ = shares(model, pa.array([w for w, _ in labelled], pa.list_(pa.string())))
        truth = np.array([[s in have for s in subjects] for _, have in labelled])
        model.shares = _calibrate(found, truth)
    model._words = {}
    return model


def _calibrate(found: np.ndarray, truth: np.ndarray, least: int = 30) -> np.ndarray:
    """For each subject the share with the best F1, near a quarter where several are as good; one for all where it has fewer than ``least`` labels."""
    grid = np.arange(0.05, 0.46, 0.01)

    def best(f: np.ndarray, t: np.ndarray) -> float:
        made = f[None] >= grid.reshape(-1, *[1] * f.ndim)
        axes = tuple(range(1, f.ndim + 1))
        f1 = 2 * (made & t).sum(axes) / np.maximum(1, made.sum(axes) + t.sum())
        good = grid[f1 >= f1.max() - 0.002]
        return float(good[np.abs(good - 0.22).argmin()])

    overall = best(found, truth)
    return np.array([best(found[:, k], truth[:, k]) if truth[:, k].sum() >= least else overall for k in range(found.shape[1])])


def text_words(text: Column) -> Column:
    """Words of a text between blanks, markup taken out; none for null."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^<>]*>", ""), f"{BLANK}+")


def fit_on(documents: DataFrame, areas: DataFrame, terms: DataFrame, labels: DataFrame, sample: int = 4000, hand: int = 2500, most_chars: int = 40_000_000) -> Model:
    """A model fitted on at most ``sample`` documents, those with the lowest hash of ``doc_id``, and calibrated on at most ``hand`` labelled ones.

    Of documents so long that these would hold more than ``most_chars`` characters fewer are taken: as many as keep within that.
    """
    size = 1 << 30
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    # Half as many again as wanted are asked for by hash, since hashes fall unevenly.
    below = lambda total, most: int(size * min(1.0, 1.5 * most / max(1, total)))
    marked = labels.where("doc_id IS NOT NULL AND subject_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject_id").alias("have"))
    ids = F.broadcast(marked.where(hashed < below(labels.count(), hand)))
    texts = documents.where("text IS NOT NULL").select("doc_id", "file_path", "source", "genre", "title", "text", hashed.alias("h")).join(ids, "doc_id", "left")
    # One pass over the texts finds both samples; what follows reads these few.
    edge = below(documents.count(), sample)
    some = materialize(texts.where((F.col("h") < edge) | F.col("have").isNotNull()))
    n, chars = some.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    fits = lambda most: int(min(most, most_chars * n / max(1, chars)))
    lowest = some.where(F.col("h") < edge).select("h").orderBy("h").limit(fits(sample)).agg(F.max("h")).first()[0]
    chosen = some.where(F.col("h") <= (-1 if lowest is None else lowest)).select("file_path", "source", "genre", "title", "h", text_words(F.col("text")).alias("words"))
    given = sorted(chosen.toArrow().to_pylist(), key=lambda d: (d["h"], d["words"]))[: fits(sample)]
    once = some.where("have IS NOT NULL").groupBy("doc_id").agg(F.min("h").alias("h"), F.min("text").alias("text"), F.first("have").alias("have")).orderBy("h").limit(fits(hand))
    known = sorted(once.select("doc_id", text_words(F.col("text")).alias("words"), "have").toArrow().to_pylist(), key=lambda d: d["doc_id"])
    release(some)
    subjects = sorted(r[0] for r in areas.where("subject_id IS NOT NULL").select("subject_id").distinct().collect())
    seeds = sorted((r[0], r[1]) for r in terms.where("subject_id IS NOT NULL AND trim(term) <> ''").select("subject_id", "term").distinct().collect())
    return fit(given, seeds, [(d["words"], set(d["have"])) for d in known], subjects)


def subject_shares(documents: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``subject_id``, ``share``, ``assigned``: every subject of each row with a share above 0.

    A null, empty or blank text has none. Repeated rows repeat. Several subjects may be assigned, or none. The columns ``carry``
    go along, those named as a column of the result with ``given_`` before their name.
    """
    made = ["subject_id", "share", "assigned"]
    given = documents.select("doc_id", *(F.col(c).alias(f"given_{c}" if c in made else c) for c in carry), F.col("text").alias("__text"))
    kinds, kept = dict(given.dtypes), given.columns[:-1]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(len(kept))
            found = np.concatenate([shares(shared.value, words.slice(start, rows))[0] for start, rows in portions(words)]) if len(words) else np.zeros((0, len(shared.value.subjects)))
            row, k = np.nonzero(found)
            ids = np.array(shared.value.subjects, np.int64)
            share = found[row, k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(len(kept))), pa.array(ids[k]), pa.array(share), pa.array(share >= shared.value.shares[k])], [*kept, *made])

    schema = ", ".join(f"{c} {kinds[c]}" for c in kept)
    return given.select(*kept, text_words(F.col("__text")).alias("__words")).mapInArrow(run, f"{schema}, subject_id long, share double, assigned boolean")


def composition(documents: DataFrame, model: Model, key: str) -> DataFrame:
    """Documents and summed shares of each subject, by the values of ``key``, for measuring a corpus by subject."""
    about = subject_shares(documents.select("doc_id", "text", F.col(key).alias("value")), model, ("value",))
    return about.groupBy("value", "subject_id").agg(F.count_if("assigned").alias("documents"), F.round(F.sum("share"), 6).alias("texts"))
