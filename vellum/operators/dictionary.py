"""Dictionaries of solutions: lookup, conflicts, merging, additions.

A dictionary is a frame of ``dict`` (``user`` or ``machine``), ``key_ord``, ``abbr``, ``expansions``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import strip
from vellum.operators.sizes import is_small


def valid_expansions(expansions: Column) -> Column:
    """The expansions of more than one character; none for null."""
    return F.filter(F.coalesce(expansions, F.array().cast("array<string>")), lambda x: F.length(x) > 1)


def _by(dictionary: DataFrame, key: Column, pick: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A row for each key with the user's and the machine's values side by side."""
    of = lambda d: valid_expansions(pick(F.when(F.col("dict") == d, F.col("expansions")), F.when(F.col("dict") == d, F.col("key_ord"))))
    return dictionary.where("abbr IS NOT NULL").groupBy(key.alias(f"__{name}")).agg(of("user").alias(f"__user_{name}"), of("machine").alias(f"__machine_{name}"))


def lookup(frame: DataFrame, key: str, dictionary: DataFrame, into: str = "expansions") -> DataFrame:
    """``frame`` with an array of what both dictionaries hold for ``key``.

    The user's values come first, then those of the machine that aren't among them. Only where neither has the key
    with a valid value, keys equal but for case count: the user's first such key, or if that has no valid value,
    the machine's. A null key has none. Two equi-joins, with dictionaries by key and by key in lower case; small ones are broadcast, after one look at their size.
    """
    send = F.broadcast if is_small(dictionary) else lambda df: df
    # A key given twice has its last value; of keys equal but for case the first counts.
    exact, folded = _by(dictionary, F.col("abbr"), F.max_by, "key"), _by(dictionary, F.lower("abbr"), F.min_by, "low")
    frame = frame.join(send(exact), F.col(key) == F.col("__key"), "left").join(send(folded), F.lower(F.col(key)) == F.col("__low"), "left")
    none = F.array().cast("array<string>")
    user, machine, user_low, machine_low = (F.coalesce(f"__{d}_{n}", none) for n in ("key", "low") for d in ("user", "machine"))
    both = F.concat(user, F.array_distinct(F.filter(machine, lambda x: ~F.array_contains(user, x))))
    alike = F.when(F.size(user_low) > 0, user_low).otherwise(machine_low)
    return frame.withColumn(into, F.when(F.size(both) > 0, both).otherwise(alike)).drop(*(f"__{x}" for x in ("key", "low", "user_key", "machine_key", "user_low", "machine_low")))


def single_values(dictionary: DataFrame, name: str) -> DataFrame:
    """``abbr``, ``value`` of one dictionary, its arrays joined by ``|``; a key given twice has its last value."""
    return dictionary.where(F.col("dict") == name).groupBy("abbr").agg(F.array_join(F.max_by("expansions", "key_ord"), "|").alias("value"))


def conflicts(machine: DataFrame, user: DataFrame, ambiguous: list[str] = ()) -> DataFrame:
    """``abbr``, ``machine_value``, ``user_value`` of keys in both (``abbr``, ``value``) with other values; ambiguous keys left out."""
    m = machine.select("abbr", F.col("value").alias("machine_value"))
    u = user.select("abbr", F.col("value").alias("user_value"))
    joined = m.join(u, "abbr").where(~F.col("machine_value").eqNullSafe(F.col("user_value")))
    return joined.where(~F.col("abbr").isin(*ambiguous)) if ambiguous else joined


def resolve(machine: DataFrame, user: DataFrame, choices: DataFrame, ambiguous: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both dictionaries (``abbr``, ``value``) after ``choices`` (``abbr``, ``choice``) for conflicting keys.

    ``M`` gives the user's dictionary the machine's value, ``U`` the machine's the user's; any other choice changes nothing.
    """
    found = conflicts(machine, user, ambiguous).join(choices.select("abbr", F.upper("choice").alias("choice")), "abbr")
    new_user = found.where("choice = 'M'").select("abbr", F.col("machine_value").alias("new"))
    new_machine = found.where("choice = 'U'").select("abbr", F.col("user_value").alias("new"))
    put = lambda old, new: old.join(new.withColumn("hit", F.lit(True)), "abbr", "left").select("abbr", F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value"))
    return put(machine, new_machine), put(user, new_user)


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both (``abbr``, ``value``) in one, the right one's value for keys in both. Also an upsert of ``right`` into ``left``."""
    r = right.select("abbr", F.col("value").alias("right_value"), F.lit(True).alias("in_right"))
    return left.select("abbr", "value").join(r, "abbr", "full_outer").select("abbr", F.when(F.col("in_right"), F.col("right_value")).otherwise(F.col("value")).alias("value"))


def ascii_only(dictionary: DataFrame) -> DataFrame:
    """Pairs (``abbr``, ``value``) of ASCII characters only."""
    return dictionary.where(~F.col("abbr").rlike(r"[^\x00-\x7F]") & ~F.coalesce("value", F.lit("")).rlike(r"[^\x00-\x7F]"))


def add_custom(dictionary: DataFrame, additions: DataFrame) -> DataFrame:
    """One dictionary (``abbr``, ``expansions``) with ``additions`` (``abbr``, ``expansion``), each added at the end unless present.

    Additions of fewer than two characters, outer blanks apart, are ignored. New keys are made. Several additions to a
    key are added in alphabetic order.
    """
    text = strip(F.col("expansion"))
    good = additions.where((F.length(text) > 1) & F.col("abbr").isNotNull()).groupBy("abbr").agg(F.sort_array(F.collect_set(text)).alias("more"))
    none = F.array().cast("array<string>")
    joined = dictionary.select("abbr", "expansions").join(good, "abbr", "full_outer")
    more = F.filter(F.coalesce("more", none), lambda x: ~F.array_contains(F.coalesce("expansions", none), x))
    return joined.select("abbr", F.concat(F.coalesce("expansions", none), more).alias("expansions"))
