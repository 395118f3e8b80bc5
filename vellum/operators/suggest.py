"""The cascade of suggestions, their ranking, choices among them, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import CONFIDENCE, lookup_key, offline_expansions, pattern_expansions, strip
from vellum.operators.dictionary import lookup
from vellum.operators.providers import SuggestionProvider, complete, top_lemmas
from vellum.operators.sizes import broadcast_if_small

_NONE = "array<struct<expansion:string,confidence:double,source:string>>"


def _given(expansions: Column, source: str) -> Column:
    return F.transform(expansions, lambda x: F.struct(x.alias("expansion"), F.lit(CONFIDENCE[source]).alias("confidence"), F.lit(source).alias("source")))


def suggestions(records: DataFrame, dictionary: DataFrame, language: str = "latin", lemmas: DataFrame | None = None, provider: SuggestionProvider | None = None, use_model: bool = True) -> DataFrame:
    """``records`` with ``lookup_key`` and ``suggestions``, an array in the order they were found.

    ``records``: ``normalized_form``, ``abbr_text``, ``context_before`` and whatever else. Dictionaries and
    patterns always count, a pattern's result only if no dictionary has it. Only where both have none,
    a key of a single letter takes up to three lemmas from ``lemmas`` (``lemma``); only where there is still none, and
    ``use_model`` is set, ``provider`` is asked, or without one the offline answers are taken. A record without
    a key has no suggestions.
    """
    keyed = records.withColumn("lookup_key", lookup_key(F.col("normalized_form"), F.col("abbr_text"), F.col("context_before")))
    found = lookup(keyed, "lookup_key", dictionary, "__known")
    made = F.filter(pattern_expansions(F.col("lookup_key"), language), lambda x: ~F.array_contains("__known", x))
    known = F.coalesce(F.concat(_given(F.col("__known"), "dictionary"), _given(made, "pattern")), F.array().cast(_NONE))
    found = found.withColumn("suggestions", F.when(F.col("lookup_key").isNull(), F.array().cast(_NONE)).otherwise(known)).drop("__known")
    if lemmas is not None:
        found = found.join(broadcast_if_small(top_lemmas(lemmas)), F.when((F.length("lookup_key") == 1) & (F.size("suggestions") == 0), F.lower("lookup_key")) == F.col("__letter"), "left")
        found = found.withColumn("suggestions", F.when(F.col("__lemmas").isNotNull(), _given(F.col("__lemmas"), "wordnet")).otherwise(F.col("suggestions"))).drop("__letter", "__lemmas")
    if not use_model:
        return found
    if provider is None:
        return found.withColumn("suggestions", F.when(F.size("suggestions") > 0, F.col("suggestions")).otherwise(_given(offline_expansions(F.col("lookup_key")), "language_model")))
    # A condition would not keep Python from seeing resolved rows, so only the others go through it.
    open_ = (F.size("suggestions") == 0) & F.col("lookup_key").isNotNull()
    answered = complete(found.where(open_), provider, getattr(provider, "count", 3)).withColumn("suggestions", _given(F.col("__answers"), "language_model")).drop("__answers")
    return found.where(~open_).unionByName(answered)


def ranked(found: DataFrame, *keep: str) -> DataFrame:
    """One row for each suggestion: ``keep``, ``rank`` from 1, ``expansion``, ``confidence``, ``source``.

    By confidence, the highest first; equal ones, and after all others those without, stay in the order they were found. Ranked within each row,
    without a shuffle.
    """
    numbered = F.transform("suggestions", lambda s, i: F.struct((-F.coalesce(s["confidence"], F.lit(-1.0))).alias("o"), i.alias("i"), s.alias("s")))
    return found.select(*keep, F.posexplode(F.array_sort(numbered)).alias("at", "x")).select(*keep, (F.col("at") + 1).alias("rank"), "x.s.expansion", "x.s.confidence", "x.s.source")


def top(found: DataFrame, *keep: str) -> DataFrame:
    """The best suggestion of each row; rows without suggestions are left out."""
    return ranked(found, *keep).where("rank = 1").drop("rank")


def without_single_letters(found: DataFrame, always: bool = False) -> DataFrame:
    """Suggestions of one character or none removed, unless there are no others; with ``always`` in any case."""
    long = F.filter("suggestions", lambda s: F.length(s["expansion"]) > 1)
    return found.withColumn("suggestions", long if always else F.when(F.size(long) > 0, long).otherwise(F.col("suggestions")))


def choose(found: DataFrame, choices: DataFrame, key: str) -> DataFrame:
    """``key``, ``expansion``, ``confidence``, ``source`` as chosen: ``choices`` has ``key``, ``choice`` (a rank) and ``custom``.

    A custom expansion of at least two characters goes before a rank, with source ``custom``. Anything else is skipped.
    """
    custom = strip(F.col("custom"))
    picked = ranked(without_single_letters(found), key).join(choices, key).where(F.col("rank") == F.col("choice")).select(key, "expansion", "confidence", "source")
    own = choices.where(F.length(custom) > 1).select(key, custom.alias("expansion"), F.lit(CONFIDENCE["custom"]).alias("confidence"), F.lit("custom").alias("source"))
    return own.unionByName(picked.join(own.select(key), key, "left_anti"))


def statistics(found: DataFrame) -> DataFrame:
    """One row of counts over records: all, those answered by each source, pattern results each, and those without any."""
    has = lambda source: F.exists("suggestions", lambda s: s["source"] == source)
    return found.agg(
        F.count("*").alias("total_suggestions"),
        F.count_if(has("dictionary")).alias("dictionary_matches"),
        F.coalesce(F.sum(F.size(F.filter("suggestions", lambda s: s["source"] == "pattern"))), F.lit(0)).cast("long").alias("pattern_matches"),
        F.count_if(has("wordnet")).alias("wordnet_suggestions"),
        F.count_if(has("language_model")).alias("lm_suggestions"),
        F.count_if(F.size("suggestions") == 0).alias("failed_abbreviations"),
    )
