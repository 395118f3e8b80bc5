"""Language of every text, and of every part of a text in several languages.

Method: nearest-centroid classification. A text is the normalised TF-IDF vector of the n-grams of its words; a
language is several centroids, found by clustering its labelled texts, and the nearest centroid by
cosine names the language. A text further from every centroid than a text of its length may be is rejected and named ``und``: how far
that is, is fitted on texts held out from a model of the others, and on foreign ones, the same texts with their letters exchanged, and lies between the two.
Its confidence is the share of held-out texts with as clear a lead of the nearest language over the next that were named rightly.

Parts: each word is compared with the centroids on its own, and the most likely course of languages over the
words is found by dynamic programming, where a change costs something, and less at a punctuation mark. Every
part is then classified as a text of its own.

Fitting takes the given samples and, for coverage, a bounded number of labelled texts for each language
(a parameter); those whose label contradicts the samples are left out. Classification covers every row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrow import flat_words, portions, ragged_take
from vellum.llm.lookalike import skeletons
from vellum.llm.splits import BLANK

# Codes and names of each language, in lower case without marks.
NAMES = {
    "eng": ["en", "eng", "english", "anglais", "inglese", "anglice", "anglicus", "anglica", "engl", "englisch"],
    "lat": ["la", "lat", "latin", "latina", "latine", "latino", "latinus", "latein"],
    "fra": ["fr", "fra", "fre", "french", "francais", "francaise", "francois", "francoise", "francese", "gallice", "gallica", "franzosisch"],
    "ita": ["it", "ita", "italian", "italiano", "italiana", "italien", "italienne", "italice", "italica", "ital", "italienisch"],
}
DIMENSIONS = 1 << 15
#: Lengths in words for which the least cosine is fitted; between them it is interpolated, beyond the last it stays.
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Held-out texts that the least cosine and the confidence are fitted on, at most.
_MEASURED = 800
#: Weight of a whole word against an n-gram of its letters. Whole words are hashed to the upper half of the dimensions.
WHOLE_WORD = 3.0
_LETTER = re.compile(r"[^\W\d_]")
_MARKS = {0x0303: "n", 0x0304: "n"}  # a stroke over a vowel stands for n or m


def named_languages(label: Column) -> Column:
    """The languages that a label names by code or name in any notation, as an array; empty for null, blank or anything else."""
    plain = F.translate(F.lower(F.coalesce(label, F.lit(""))), "çéèàùâêîôûäöü", "ceeauaeiouaou")
    parts = F.split(plain, r"[,;/&+|]|\band\b|\bet\b|\be\b")
    primary = F.transform(parts, lambda p: F.regexp_extract(p, r"^[^\p{L}]*(\p{L}+)", 1))
    known = [F.when(F.arrays_overlap(primary, F.array(*map(F.lit, names))), F.lit(lang)) for lang, names in NAMES.items()]
    return F.array_compact(F.array(*known))


def folded(words: list[str]) -> list[str]:
    """Words with the freedoms of early spelling taken out: look-alikes, case, long s, u/v, i/j/y, and strokes for n or m."""
    import unicodedata

    found = []
    for s in skeletons(words):
        w = unicodedata.normalize("NFD", s.lower()).translate(_MARKS)
        w = w.replace("ſ", "s").replace("v", "u").replace("j", "i").replace("y", "i").replace("mp", "np").replace("mb", "nb")
        found.append("".join(ch for ch in w if _LETTER.match(ch)))
    return found


def features(word: str) -> list[int]:
    """Hashed n-grams of two to four letters of a folded word, with its ends marked, and the whole word."""
    marked = f"<{word}>"
    half = DIMENSIONS // 2
    grams = {zlib.crc32(marked[i : i + n].encode()) % half for n in (2, 3, 4) for i in range(len(marked) - n + 1)}
    return [*sorted(grams), half + zlib.crc32(marked.encode()) % half]


@dataclass
class Model:
    """Centroids (rows) with the language each belongs to, weights of the n-grams, the least cosine accepted by number of words, and the logistic curve of confidence."""

    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray = field(default_factory=lambda: np.zeros(LENGTHS[-1] + 1))
    trust: tuple[float, float] = (0.0, 2.0)
    _words: dict = field(default_factory=dict)

    def word_table(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: dot products with the centroids, log posteriors, feature starts, feature counts, all features."""
        fresh = [t for t in dict.fromkeys(tokens) if t not in self._words]
        if len(self._words) + len(fresh) > 300_000:
            self._words.clear()
            fresh = list(dict.fromkeys(tokens))
        for t, w in zip(fresh, folded(fresh), strict=True):
            f = np.array(features(w) if w else [], np.int64)
            v = self.idf[f]
            dots = self.centroids[:, f] @ v if len(f) else np.zeros(len(self.of), np.float32)
            near = np.array([dots[self.of == k].max() for k in range(len(self.languages))]) / max(1e-9, float(np.sqrt(v @ v)))
            share = (np.maximum(near, 0) + 0.01) ** 1.5
            self._words[t] = dots, np.log(share / share.sum()), f
        rows = [self._words[t] for t in tokens]
        n = np.fromiter((len(r[2]) for r in rows), np.int64, len(rows))
        if not rows:
            return np.zeros((0, len(self.of))), np.zeros((0, len(self.languages))), n, n, np.zeros(0, np.int64)
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.cumsum(n) - n, n, np.concatenate([r[2] for r in rows])

    def cosines(self, part: np.ndarray, n_parts: int, codes: np.ndarray, table: tuple) -> np.ndarray:
        """Cosine of each part with each language's nearest centroid; ``part`` is the part of each word."""
        dots, _, starts, counts, all_features = table
        at, _ = ragged_take(starts, counts, codes)
        owner = np.repeat(part, counts[codes])
        keys = np.sort(owner * DIMENSIONS + all_features[at])
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.r_[edge, len(keys)])
        square = np.bincount(keys[edge] // DIMENSIONS, (times * self.idf[keys[edge] % DIMENSIONS]) ** 2, n_parts)
        total = np.stack([np.bincount(part, dots[codes, c], n_parts) for c in range(len(self.of))], 1) if n_parts else np.zeros((0, len(self.of)))
        near = total / np.sqrt(np.maximum(square, 1e-12))[:, None]
        return np.stack([near[:, self.of == k].max(1) for k in range(len(self.languages))], 1)


    def accepted(self, top: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether parts of so many words are near enough."""
        return top >= self.least[np.minimum(words, len(self.least) - 1)]

    def confidence(self, near: np.ndarray) -> np.ndarray:
        """How sure the nearest language of each part is, from its lead over the next; 1 for a model of one language."""
        return 1 / (1 + np.exp(-(self.trust[0] + self.trust[1] * _lead(near)))) if near.shape[1] > 1 else np.ones(len(near))

    def of_texts(self, texts: list[list[str]]) -> np.ndarray:
        """Cosines of whole texts, given as words."""
        tokens = list(dict.fromkeys(w for ws in texts for w in ws))
        number = {w: i for i, w in enumerate(tokens)}
        part = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
        return self.cosines(part, len(texts), np.fromiter((number[w] for ws in texts for w in ws), np.int64, len(part)), self.word_table(tokens))


def _lead(near: np.ndarray) -> np.ndarray:
    """Logarithm of the nearest language's cosine over the next one's, at most 3."""
    order = np.sort(np.maximum(near, 1e-3), axis=1)
    return np.minimum(np.log(order[:, -1] / order[:, -2]), 3.0)


def _tfidf(texts: list[list[int]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and normalised weight of each text's vector."""
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keys, times = np.unique(row * DIMENSIONS + np.fromiter((f for t in texts for f in t), np.int64, len(row)), return_counts=True)
    r, f = keys // DIMENSIONS, keys % DIMENSIONS
    w = times * idf[f]
    norm = np.sqrt(np.bincount(r, w * w, len(texts)))
    return r, f, w / np.maximum(norm, 1e-12)[r]


def fit(samples: list[tuple[str, str]], labelled: list[tuple[str, str]] = (), clusters: int = 4, rejected: float = 0.002, measure: bool = True) -> Model:
    """Fit on (language, text) pairs: ``samples`` are trusted, ``labelled`` only where a model of the samples agrees.

    ``clusters``: most centroids for each language. ``rejected``: share of held-out texts of any length that may be turned away.
    ``measure``: whether to fit the least cosine and the confidence; else nothing is rejected. No samples, or of one language only: that is
    all the model knows.
    """
    if labelled:
        first = fit(samples, (), clusters, measure=False)
        near = first.of_texts([t.split() for _, t in labelled])
        samples = [*samples, *(pair for pair, best in zip(labelled, near.argmax(1), strict=True) if first.languages[best] == pair[0])]
    languages = sorted({lang for lang, _ in samples})
    known = {w: features(f) if f else [] for ws in [list(dict.fromkeys(w for _, t in samples for w in t.split()))] for w, f in zip(ws, folded(ws), strict=True)}
    texts = [[f for w in t.split() for f in known[w]] for _, t in samples]
    seen = np.zeros(DIMENSIONS)
    for t in texts:
        seen[list(set(t))] += 1
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    idf[DIMENSIONS // 2 :] *= WHOLE_WORD
    row, feat, weight = _tfidf(texts, idf)
    label = np.array([languages.index(lang) for lang, _ in samples])
    centroids, of = [], []
    for k in range(len(languages)):
        mine = np.flatnonzero(label == k)
        found = _cluster(mine, row, feat, weight, min(clusters, max(1, len(mine) // 10)))
        centroids += list(found)
        of += [k] * len(found)
    model = Model(languages, np.array(of), np.array(centroids, np.float32), idf)
    if measure and len(samples) > 1:
        held = samples[1::2]
        model.least, model.trust = _limits(fit(samples[::2], (), clusters, measure=False), held[:: -(-len(held) // _MEASURED)], rejected)
    return model


def _foreign(words: list[str], seed: int) -> list[str]:
    """Words in no language: their letters exchanged by a permutation of the alphabet."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join(folded(words)).translate(str.maketrans(letters, "".join(np.random.default_rng(seed).permutation(list(letters))))).split()


def _limits(other: Model, held: list[tuple[str, str]], rejected: float) -> tuple[np.ndarray, tuple[float, float]]:
    """The least cosine by number of words, and the curve of confidence, from texts ``held`` out of the model ``other``."""
    limits, leads, right = [], [np.zeros(0)], [np.zeros(0)]
    for k in LENGTHS:
        some = [(lang, w[:k]) for lang, w in ((lang, t.split()) for lang, t in held) if len(w) >= k and lang in other.languages]
        if len(some) < 10 and limits:
            limits.append(limits[-1])
            continue
        near = other.of_texts([w for _, w in some])
        own = near.max(1, initial=0.0)
        foreign = other.of_texts([_foreign(w, i) for i, (_, w) in enumerate(some)]).max(1, initial=0.0)
        low, high = (float(np.quantile(own, rejected)), float(np.quantile(foreign, 1 - rejected))) if some else (0.0, 0.0)
        # Where the two lie apart, the middle on a scale of ratios; where they mix, own texts go first.
        limits.append(float(np.sqrt(low * high)) if low > high else low)
        if near.shape[1] > 1:
            leads.append(_lead(near))
            right.append(np.array([other.languages[b] == lang for b, (lang, _) in zip(near.argmax(1), some, strict=True)], float))
    return np.interp(np.arange(LENGTHS[-1] + 1), LENGTHS, limits), _logistic(np.concatenate(leads), np.concatenate(right))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 20) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps, drawn a little towards (0, 2)."""
    w = np.array([0.0, 2.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (y - p) - 0.5 * (w - (0.0, 2.0))
        w = w + np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.5 * np.eye(2), gradient)
    return float(w[0]), float(w[1])


def _cluster(mine: np.ndarray, row: np.ndarray, feat: np.ndarray, weight: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means over some rows; the first centres are rows at even steps, so the result is always the same."""
    at = np.full(int(row.max(initial=-1)) + 1, -1)
    at[mine] = np.arange(len(mine))
    use = at[row] >= 0
    r, f, w = at[row[use]], feat[use], weight[use]
    group = np.arange(len(mine)) % k
    for _ in range(rounds):
        centres = np.stack([np.bincount(f, w * (group[r] == g), DIMENSIONS) for g in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        group = np.stack([np.bincount(r, w * c[f], len(mine)) for c in centres], 1).argmax(1)
    return centres


def _course(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Language of each word: the course of highest score over each row, all rows stepped together.

    ``cost[i]``: of a change just before word i.
    """
    n, k = scores.shape
    back = np.zeros((n, k), np.int8)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    best = np.zeros((len(starts), k))
    last = np.zeros(n, np.int8)
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # rows longer than each step
    for step in range(longest):
        m = active[step]
        at = starts[:m] + step
        if step == 0:
            best[:m] = scores[at]
            continue
        top = best[:m].argmax(1)
        change = best[np.arange(m), top] - cost[at]
        stay = best[:m]
        moved = change[:, None] > stay
        back[at] = np.where(moved, top[:, None], np.arange(k)[None, :])
        best[:m] = np.where(moved, change[:, None], stay) + scores[at]
    state = best.argmax(1)
    for step in range(longest - 1, -1, -1):
        m = active[step]
        # Rows ending at this step start here from their best state.
        at = starts[:m] + step
        last[at] = state[:m]
        if step:
            state[:m] = back[at, state[:m]]
    return last


def detect(model: Model, words: pa.Array, change: float = 5.5, at_mark: float = 3.0) -> dict[str, np.ndarray]:
    """Parts of each row of a batch: row, first (word), words, lang (number, -1 rejected), confidence."""
    rows, codes, tokens = flat_words(words)
    is_word = np.fromiter((bool(_LETTER.search(t)) for t in tokens), bool, len(tokens))
    opens = np.fromiter((bool(t) and not t[0].isalnum() for t in tokens), bool, len(tokens))
    closes = np.fromiter((bool(t) and t[-1] in ".,;:!?/—)]" for t in tokens), bool, len(tokens))
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    good = is_word[codes] if len(codes) else np.zeros(0, bool)
    between = np.cumsum(~good)
    codes, row_of, between = codes[good], row_of[good], between[good]
    n = len(codes)
    mark = np.zeros(n, bool)
    if n:
        mark[1:] = closes[codes[:-1]] | opens[codes[1:]] | (between[1:] != between[:-1])
    lengths = np.bincount(row_of, minlength=len(rows) - 1)
    starts = np.cumsum(lengths) - lengths
    table = model.word_table(tokens)
    lang = _course(table[1][codes], starts, lengths, np.where(mark, at_mark, change))
    new = np.ones(n, bool)
    new[1:] = (row_of[1:] != row_of[:-1]) | (lang[1:] != lang[:-1])
    first = np.flatnonzero(new)
    part = np.cumsum(new) - 1
    near = model.cosines(part, len(first), codes, table)
    while True:
        best = near.argmax(1) if len(first) else np.zeros(0, np.int64)
        top = near[np.arange(len(first)), best]
        good = model.accepted(top, np.diff(np.r_[first, n]))
        # Neighbours in one language are one part, classified again as a whole, until none are left.
        same = (row_of[first][1:] == row_of[first][:-1]) & (best[1:] == best[:-1]) & good[1:] & good[:-1]
        if not same.any():
            break
        into, joined = np.r_[False, same], np.r_[same, False]
        new[first[into]] = False
        first, near, joined = first[~into], near[~into], joined[~into]
        part = np.cumsum(new) - 1
        inside = joined[part]
        near[joined] = model.cosines((np.cumsum(joined) - 1)[part[inside]], int(joined.sum()), codes[inside], table)
    return {
        "row": row_of[first],
        "first": first - starts[row_of[first]],
        "words": np.diff(np.r_[first, n]),
        "lang": np.where(good, best, -1),
        "confidence": np.where(good, model.confidence(near), 0.0) if n else np.zeros(0),
    }


def language_parts(texts: DataFrame, key: str, fields: list[str], model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``field``, ``first_word``, ``n_words``, ``lang``, ``confidence``: one row for each part of each field of each row.

    A text in one language has one part, and no two neighbours of one row are in the same language, ``und`` aside. ``first_word`` counts from 0. ``lang`` is ``und`` where the part is like
    no language of the model, with a confidence of 0. Null, empty and blank texts, and those without a letter, have no part. Whole texts
    are read, whatever their length; repeated rows repeat. The columns ``carry`` go along, those named as a column of the result with ``given_`` before their name. No shuffle; the model is broadcast, and its size
    depends on the numbers of languages, centroids and n-gram dimensions alone.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    made = ["field", "first_word", "n_words", "lang", "confidence"]
    given = texts.select(key, *(F.col(c).alias(f"given_{c}" if c in made else c) for c in carry), *(F.col(f).alias(f"__{f}") for f in fields))
    kinds = dict(given.dtypes)
    kept = given.columns[: 1 + len(carry)]
    split = lambda c: F.split(F.coalesce(c, F.lit("")), f"{BLANK}+")
    names = pa.array([*model.languages, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(fields, start=len(kept)):
                for start, rows in portions(batch.column(i)):
                    found = detect(shared.value, batch.column(i).slice(start, rows))
                    n = len(found["row"])
                    row = pa.array(found["row"] + start)
                    lang = names.take(pa.array(np.where(found["lang"] < 0, len(names) - 1, found["lang"])))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(row) for k in range(len(kept))), pa.array([name] * n, pa.string()), pa.array(found["first"].astype(np.int32)), pa.array(found["words"].astype(np.int32)), lang.cast(pa.string()), pa.array(found["confidence"].astype(np.float64))],
                        [*kept, *made],
                    )

    schema = ", ".join(f"{c} {kinds[c]}" for c in kept)
    return given.select(*kept, *(split(F.col(f"__{f}")).alias(f"__{f}") for f in fields)).mapInArrow(run, f"{schema}, field string, first_word int, n_words int, lang string, confidence double")


def fit_on(samples: DataFrame, labelled: DataFrame, label: Column, text: Column, key: str, per_language: int = 1500) -> Model:
    """A model of ``samples`` (``lang``, ``text``) and of at most ``per_language`` texts that ``label`` says are in each language.

    Those with the lowest hash of ``key`` are taken. Only they reach the driver.
    """
    one = labelled.select(named_languages(label).alias("langs"), text.alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h")).where("size(langs) = 1 AND length(text) >= 40").select(F.col("langs")[0].alias("lang"), "text", "h")
    # Counted by label alone, so that this reads no text.
    sizes = {r["lang"]: r["count"] for r in labelled.select(named_languages(label).alias("langs")).where("size(langs) = 1").groupBy(F.col("langs")[0].alias("lang")).count().collect()}
    below = F.lit(0)
    for lang, size in sizes.items():  # half as many again as wanted, since hashes fall unevenly
        below = F.when(F.col("lang") == lang, int((1 << 30) * min(1.0, 1.5 * per_language / size))).otherwise(below)
    rows = sorted((d["h"], d["lang"], d["text"]) for d in one.where(F.col("h") < below).toArrow().to_pylist())
    ranked = [pair for lang in sizes for pair in [(x[1], x[2]) for x in rows if x[1] == lang][:per_language]]
    given = [(r["lang"], r["text"]) for r in samples.where("lang IS NOT NULL AND text IS NOT NULL").orderBy("sample_id").select("lang", "text").collect()]
    return fit(given, sorted(ranked))


def unnamed_runs(records: DataFrame, model: Model, least_words: int = 6) -> DataFrame:
    """``abbr_no``, ``field``, ``lang`` of contexts with a run of at least ``least_words`` words in a language the record's label doesn't name."""
    given = records.select("abbr_no", "context_before", "context_after", named_languages(F.col("metadata.language")).alias("named"))
    parts = language_parts(given, "abbr_no", ["context_before", "context_after"], model, ("named",))
    found = parts.where((F.col("n_words") >= least_words) & (F.col("lang") != "und") & ~F.array_contains("named", F.col("lang")))
    return found.select("abbr_no", "field", "lang").distinct()
