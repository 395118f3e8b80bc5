"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import frequency, language, lookalike, overlap, packing, splits, subjects, tokens
from vellum.llm.sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["QUERIES", "SQL"]


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Problem 1: splits that keep related records together.


@_query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of files of ``dataset_entries`` that must share a split."""
    return splits.tied_pairs(_table(spark, folder, "dataset_entries"))


@_query
def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """New split of every entry, stratified by genre."""
    return splits.assign_splits(_table(spark, folder, "dataset_entries"), F.col("metadata.genre"))


@_query
def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Files that must share a split, with the group of each."""
    return splits.tie_groups(_table(spark, folder, "dataset_entries"))


@_query
def p1_balance(spark: SparkSession, folder: str) -> DataFrame:
    """How the new splits keep groups together and proportions: each split's groups torn, and whether it is within two in a hundred of its share overall, and within ten in a hundred by genre."""
    entries = _table(spark, folder, "dataset_entries")
    genre = entries.select("entry_no", F.col("metadata.genre").alias("genre"))
    found = splits.balance(splits.assign_splits(entries, F.col("metadata.genre")).join(genre, "entry_no"), "genre")
    return found.select("new_split", "parted_groups", (F.col("deviation") < 0.02).alias("in_proportion"), (F.col("label_deviation") < 0.1).alias("in_proportion_by_genre"))


# Problem 2: visually identical text.


@_query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Disguised spellings of accepted forms in ``abbr_records``."""
    return lookalike.find_lookalikes(_table(spark, folder, "abbr_records"), _table(spark, folder, "abbr_forms"), ["abbr_no"], ["abbr_text", "normalized_form"])


@_query
def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of ``abbr_text``, and of ``normalized_form``, that share a skeleton."""
    return lookalike.groups_by_look(_table(spark, folder, "abbr_records"), ["abbr_text", "normalized_form"], "abbr_no")


# Problem 3: missing or wrong language labels.


def _language_model(spark: SparkSession, folder: str) -> language.Model:
    records = _table(spark, folder, "abbr_records")
    text = F.concat_ws(" ", "context_before", "context_after")
    return language.fit_on(_table(spark, folder, "lang_samples"), records, F.col("metadata.language"), text, "abbr_no")


@_query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts of ``abbr_records`` with six words in a row in a language their label doesn't name."""
    return language.unnamed_runs(_table(spark, folder, "abbr_records"), _language_model(spark, folder))


@_query
def p3_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every part of both contexts of ``abbr_records``, with its confidence."""
    parts = language.language_parts(_table(spark, folder, "abbr_records"), "abbr_no", ["context_before", "context_after"], _language_model(spark, folder))
    return parts.withColumn("confidence", F.round("confidence", 4))


@_query
def p3_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every part of every document."""
    parts = language.language_parts(_table(spark, folder, "documents"), "doc_id", ["text"], _language_model(spark, folder))
    return parts.withColumn("confidence", F.round("confidence", 4))


# Problem 4: overlaps across splits.


@_query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entries that agree across train and the other splits."""
    return overlap.cross_split_pairs(_table(spark, folder, "dataset_entries"))


@_query
def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping entries and their links by split and source file."""
    return overlap.report(_table(spark, folder, "dataset_entries"))


# Problem 6: frequency of every term.


@_query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of ``user_decisions`` in too few or too many decisions."""
    once = frequency.decisions_once(_table(spark, folder, "user_decisions"))
    counts = frequency.count_ngrams(frequency.decision_terms(once), sigma=3).where("n = 1")
    return frequency.mark(counts, once.count()).where(F.col("mark").isNotNull()).select("field", "term", "mark")


@_query
def p6_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every run of one to three words in both fields of ``user_decisions``."""
    once = frequency.decisions_once(_table(spark, folder, "user_decisions"))
    return frequency.count_ngrams(frequency.decision_terms(once), sigma=3)


# Problem 7: encoding of the whole corpus.


@_query
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(_table(spark, folder, "documents"))


@_query
def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents decoded from their ids, beside whether that gives the text again (null and empty texts give '')."""
    documents = _table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("given"))
    return tokens.decode(tokens.encode(_table(spark, folder, "documents"))).join(documents, "doc_id").select("doc_id", F.length("text").alias("n_chars"), (F.col("text") == F.col("given")).alias("same"))


# Problem 8: filling containers.


@_query
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every document, of 1,024 tokens each."""
    return packing.pack_documents(_table(spark, folder, "documents"))


@_query
def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(packing.pack_documents(_table(spark, folder, "documents")))


@_query
def p8_exchange(spark: SparkSession, folder: str) -> DataFrame:
    """The same as ``p8_kept`` where documents are dealt to partitions of 200, so that partitions with gaps exchange."""
    return packing.kept_whole(packing.pack_documents(_table(spark, folder, "documents"), per_part=200))


@_query
def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document is in one piece, unless it alone exceeds a container, and its containers hold no more than they can."""
    return packing.kept_whole(packing.pack_documents(_table(spark, folder, "documents")))


# Problem 9: subject areas.


def _subject_model(spark: SparkSession, folder: str) -> subjects.Model:
    return subjects.fit_on(*(_table(spark, folder, t) for t in ("documents", "subject_areas", "subject_terms", "doc_labels")))


@_query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of every document."""
    found = subjects.subject_shares(_table(spark, folder, "documents"), _subject_model(spark, folder))
    return found.where("assigned").select("doc_id", "subject_id")


@_query
def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by genre and subject."""
    return subjects.composition(_table(spark, folder, "documents"), _subject_model(spark, folder), "genre")
