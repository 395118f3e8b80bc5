"""Saved decisions: the last one for each key, and the training entries they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import not_empty
from vellum.operators import pick


def last_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each ``key``, the last in ``order``, with ``first_order``: the order of the first.

    So a decision made again takes the place of the earlier one, at its position. A null key is a key; rows alike in ``order`` are
    told apart by a hash of their content.
    """
    return pick.by_key(rows, key, order, last=True, first_order="first_order")


def best_decisions(suggested: DataFrame, order: str) -> DataFrame:
    """Decisions from the best suggestion of each record (``order``: a number that follows the records' order).

    The key is the abbreviation's text, else its normalized form, else ``unknown_`` and the number; the value is that of
    the last record with the key, ``first_at`` the number of the first.
    """
    key = F.coalesce(not_empty(F.col("abbr_text")), not_empty(F.col("normalized_form")), F.concat(F.lit("unknown_"), F.col(order).cast("string")))
    kept = last_by_key(suggested.withColumn("abbr_key", key), "abbr_key", [order])
    return kept.withColumn("first_at", F.col(f"first_order.{order}")).drop("first_order")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each ``abbr_key``, by time and number, with ``first_no``, the number of the first."""
    kept = last_by_key(decisions, "abbr_key", ["decided_at", "decision_no", "loaded_at"])
    return kept.withColumn("first_no", F.col("first_order.decision_no")).drop("first_order")


def decision_entries(decisions: DataFrame) -> DataFrame:
    """Training entries: ``abbreviation`` (else the key), ``expansion``, both contexts, ``source`` with file, confidence and type, ``metadata``."""
    text = lambda c: F.coalesce(c, F.lit(""))
    source = F.struct(text("file_path").alias("file"), F.col("confidence").alias("confidence"), F.col("source").alias("source_type"))
    return decisions.select("abbr_key", F.coalesce(not_empty(F.col("abbreviation")), "abbr_key").alias("abbreviation"), "expansion", text("context_before").alias("context_before"), text("context_after").alias("context_after"), source.alias("source"), "metadata")
