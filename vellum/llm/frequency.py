"""Frequency of every distinct term, and of every run of terms up to a length.

Method: suffix-sorted n-gram counting. From each position of a record's terms the suffix cut to
``sigma`` terms is emitted, routed by its first term, sorted in reverse lexicographic order, and all
prefixes are counted in one pass with a stack: whatever two neighbouring suffixes share stays open,
the rest is closed and reported.

Number of records: an emitted suffix says of each of its prefixes whether that prefix occurs in the
record for the first time, so the sum of these marks is the number of records, and no set of record
ids is held.

Skew: equal suffixes are counted before they are routed, so a frequent term is as many rows as it has
distinct suffixes. A first term that still has more than ``hot`` of them is routed by its first two
terms; the prefix of length one is then added up over those routes afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.lookalike import term_key
from vellum.storage import materialize

_SEP = "\u0001"  # sorts before every character of a term; terms hold no control characters


def _suffixes(batches: Iterator[pd.DataFrame], sigma: int) -> Iterator[pd.DataFrame]:
    """(field, suffix, cnt, firsts): the truncated suffixes of each record, equal ones of a batch counted."""
    for pdf in batches:
        counts: dict[tuple[str, str], list[int]] = {}
        for field, terms in zip(pdf["field"], pdf["terms"], strict=True):
            seen: set[str] = set()
            n = len(terms)
            for i in range(n):
                cut = _SEP.join(terms[i : i + sigma])
                entry = counts.get((field, cut))
                if entry is None:
                    entry = counts[field, cut] = [0] * (sigma + 1)
                entry[0] += 1
                gram = ""
                for k in range(1, min(sigma, n - i) + 1):
                    gram = gram + _SEP + terms[i + k - 1]
                    if gram not in seen:
                        seen.add(gram)
                        entry[k] += 1
        yield pd.DataFrame({"field": [k[0] for k in counts], "suffix": [k[1] for k in counts], "cnt": [v[0] for v in counts.values()], **{f"df{k}": [v[k] for v in counts.values()] for k in range(1, sigma + 1)}})


def _stack(batches: Iterator[pd.DataFrame], sigma: int) -> Iterator[pd.DataFrame]:
    """All prefix counts of suffixes that arrive sorted by route and in reverse lexicographic order."""
    route, open_terms, counts, records = None, [], [], []
    out: list[tuple] = []

    def close(to: int) -> None:
        while len(open_terms) > to:
            out.append((route[0], _SEP.join(open_terms), len(open_terms), counts[-1], records[-1]))
            open_terms.pop()
            done = counts.pop()
            records.pop()
            if counts:
                counts[-1] += done  # an occurrence of the longer run is one of the shorter

    for pdf in batches:
        for field, key, suffix, cnt, *firsts in pdf[["field", "route", "suffix", "cnt", *(f"df{k}" for k in range(1, sigma + 1))]].itertuples(index=False):
            if (field, key) != route:
                close(0)
                route = (field, key)
            terms = suffix.split(_SEP)
            same = 0
            while same < len(open_terms) and same < len(terms) and open_terms[same] == terms[same]:
                same += 1
            close(same)
            for term in terms[same:]:
                open_terms.append(term)
                counts.append(0)
                records.append(0)
            counts[-1] += cnt
            for k in range(len(terms)):
                records[k] += firsts[k]
        yield pd.DataFrame(out, columns=["field", "term", "n", "occurrences", "records"])
        out = []
    close(0)
    yield pd.DataFrame(out, columns=["field", "term", "n", "occurrences", "records"])


def count_ngrams(records: DataFrame, sigma: int = 1, hot: int = 100_000) -> DataFrame:
    """Occurrences and number of records of every run of 1 to ``sigma`` terms.

    ``records``: ``field`` (counted apart) and ``terms``, an array of terms, one row for each record; other
    columns are ignored. Returns ``field``, ``term`` (terms parted by one blank), ``n`` (terms in it),
    ``occurrences``, ``records``. A null or empty array gives nothing; null and empty terms are left out
    first, and so aren't counted nor stand between their neighbours. Terms holding U+0001 have it taken out.
    """
    clean = F.filter(F.transform("terms", lambda t: F.replace(t, F.lit(_SEP), F.lit(""))), lambda t: t.isNotNull() & (t != ""))
    given = records.select("field", clean.alias("terms")).where(F.size("terms") > 0)
    firsts = [f"df{k}" for k in range(1, sigma + 1)]
    schema = "field string, suffix string, cnt long, " + ", ".join(f"{c} long" for c in firsts)
    counted = given.mapInPandas(lambda it: _suffixes(it, sigma), schema).groupBy("field", "suffix").agg(*(F.sum(c).alias(c) for c in ("cnt", *firsts)))
    parts = F.split("suffix", _SEP)
    first = parts[0]
    if sigma > 1:
        counted = materialize(counted)
        # Of the distinct suffixes at most one in ``hot`` names a hot first term, so these few are sent along and no term is shuffled by itself.
        heavy = counted.groupBy("field", first.alias("first")).agg(F.count("*").alias("size")).where(F.col("size") > hot).select("field", "first", F.lit(True).alias("heavy"))
        counted = counted.withColumn("first", first).join(F.broadcast(heavy), ["field", "first"], "left")
        route = F.when(F.col("heavy") & (F.size(parts) > 1), F.concat(parts[0], F.lit(_SEP), parts[1])).otherwise(first)
    else:
        route = first
    # Reverse order puts a run before its own prefix, so what is open when a run ends is exactly its prefixes.
    routed = counted.select("field", route.alias("route"), "suffix", "cnt", *firsts).repartition("field", "route").sortWithinPartitions("field", "route", F.desc("suffix"))
    out = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())])
    found = routed.mapInPandas(lambda it: _stack(it, sigma), out)
    if sigma > 1:  # the first term of a heavy route is reported by each of its routes
        found = found.groupBy("field", "term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return found.withColumn("term", F.replace("term", F.lit(_SEP), F.lit(" ")))


def mark(counts: DataFrame, total: int, rare: int = 2, common: int = 50) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in at most ``rare`` records, ``common`` in more than one in ``common`` of ``total``, else null.

    ``rare`` goes first where both hold, in collections of fewer than ``rare * common`` records.
    """
    rule = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common > total, "common")
    return counts.withColumn("mark", rule)


def decisions_once(decisions: DataFrame) -> DataFrame:
    """``decision_no``, ``abbreviation``, ``expansion``, each decision once.

    Deliveries of one ``decision_no`` have the same content, so the lowest value of each field stands for
    them. Rows without ``decision_no`` can't be told to be repeated; each counts as a decision.
    """
    columns = ["decision_no", "abbreviation", "expansion"]
    given = decisions.select(*columns)
    once = given.where(F.col("decision_no").isNotNull()).groupBy("decision_no").agg(F.min("abbreviation").alias("abbreviation"), F.min("expansion").alias("expansion"))
    return once.unionByName(given.where(F.col("decision_no").isNull()))


def decision_terms(once: DataFrame) -> DataFrame:
    """``field``, ``terms`` of each decision: the whole ``abbreviation``, and the words of ``expansion``.

    Null and blank values give no terms. Words are parted by blanks of any kind and lose ``,`` ``.`` ``;`` at
    their end; same-looking spellings and cases are one term, written in lower case.
    """
    both = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("abbreviation", "expansion")))
    keyed = once.select(F.explode(both).alias("x")).select("x.field", "x.text").where(F.col("text").isNotNull()).select("field", term_key("text").alias("text"))
    words = F.transform(F.split("text", " "), lambda w: F.regexp_replace(w, "[,.;]+$", ""))
    return keyed.select("field", F.when(F.col("field") == "expansion", words).otherwise(F.array("text")).alias("terms"))
