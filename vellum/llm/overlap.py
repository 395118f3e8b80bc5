"""Same or nearly the same records across splits.

Method: exact prefix-filter bipartite join on rare shingles. Two texts agree when the longest common
subsequence of their words has at least five sixths of the words of the longer one. Every such pair
shares most of its word pairs (shingles of two words, equal ones numbered), so several of the rarest of each text
must meet; how many are to be looked at follows from the number of words alone. A few more than the least are taken, and as
many more must be shared, which chance meetings in a large group seldom do. Evaluation prefixes are the index,
training prefixes probe it, lengths and positions in the prefix rule out more, and whatever is left is
verified on the whole texts. Nothing is capped, so no pair is lost.

Five-word shingles would not do: one changed word in six breaks all of them, so two words are taken.

Rarity comes from a sketch of fixed size with the count of each hashed word pair over all texts. The sketch
only orders shingles; a collision makes a candidate more, never a pair less.

A shingle that the sketch counts far more often than others is parted: index rows go to one of several parts by their class, and a
probing row goes to all of them, so that no task takes all that meet in one shingle.

Texts equal in abbreviation and words are one class; the join runs between classes, and their
members are put back at the end. Only numbers travel for this; a text is shuffled once, where classes are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrow import flat_words
from vellum.llm.lookalike import readings, term_key
from vellum.llm.splits import file_key
from vellum.operators.sizes import broadcast_if_small, spread_join
from vellum.storage import materialize

#: Numerator and denominator of the share of words that must agree.
SHARE = (5, 6)
SKETCH = 1 << 18
#: Shingles taken beyond the least prefix; a pair must then share one more than these within the prefixes.
EXTRA = 2
#: Times the mean count of a sketch's cells, and least count, from which a shingle is parted; a part for each such number of occurrences.
HOT = (32, 50_000)


#: Whatever is no letter, mark, digit or blank.
_NO_WORD = regex.compile(r"[^\p{L}\p{M}\p{N} ]+")


def word_text(texts: list[str]) -> list[str]:
    """The words of each text, parted by one blank: look-alikes made one, lower case, without punctuation."""
    return [" ".join(_NO_WORD.sub("", read).split()) for read in readings(texts)]


def needed(longer: int) -> int:
    """Words that must agree where the longer text has so many."""
    return -(-SHARE[0] * longer // SHARE[1])


def breakable(n: int) -> int:
    """Most shingles of a text of ``n`` words that a text agreeing with it may lack.

    A word that agrees with none breaks two shingles of its own text, and one of the other.
    """
    most = 0
    for other in range(needed(n), n * SHARE[1] // SHARE[0] + 1):
        agree = needed(max(n, other))
        if agree <= min(n, other):
            most = max(most, 2 * (n - agree) + (other - agree))
    return most


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: one step for each word of ``b``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        m = at.get(w, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _agree(a: str, b: str) -> bool:
    x, y = a.split(" "), b.split(" ")
    return lcs(x, y) >= needed(max(len(x), len(y)))


def _mix(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x ^ (y + np.uint64(0x9E3779B97F4A7C15) + (x << np.uint64(6)) + (x >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(31))


def _shingles(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and hash, of every pair of neighbouring words, and the number of words of each row."""
    rows, codes, distinct = flat_words(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]
    n = rows[1:] - rows[:-1]
    row_of = np.repeat(np.arange(len(n)), n)
    same = row_of[1:] == row_of[:-1] if len(row_of) else np.zeros(0, bool)
    return row_of[:-1][same] if len(row_of) else row_of, _mix(hashes[:-1][same], hashes[1:][same]) if len(row_of) else hashes, n


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        _, pairs, _ = _shingles(batch.column(0))
        counts += np.bincount((pairs % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], sketch, block: int, probing: bool) -> Iterator[pa.RecordBatch]:
    """(token, cid, n, pos): the rarest shingles of each class, so many that enough of them must meet.

    A shingle counted more than ``block`` times has parts; a probing row is put out for each of them, an indexed one for its own.
    """
    longest = 1024
    table = np.array([breakable(k) for k in range(longest)])
    for batch in batches:
        row, pairs, n = _shingles(batch.column(1))
        keys = np.array([xxhash.xxh64_intdigest(a) for a in batch.column(2).to_pylist()], np.uint64)
        order = np.lexsort((pairs, row))
        row, pairs = row[order], pairs[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (pairs[1:] != pairs[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else row
        times = (np.arange(len(row)) - first).astype(np.uint64)
        token = _mix(_mix(pairs, keys[row]), times)
        weight = sketch.value[(pairs % np.uint64(SKETCH)).astype(np.int64)]
        order = np.lexsort((token, weight, row))
        row, token, weight = row[order], token[order], weight[order]
        start = np.searchsorted(row, np.arange(len(n)))
        pos = np.arange(len(row)) - start[row] if len(row) else row
        # A text of fewer than five words agrees with no other than its equals.
        most = np.where(n < longest, table[np.minimum(n, longest - 1)], [breakable(int(k)) if k >= longest else 0 for k in n])
        keep = (pos <= most[row] + EXTRA) & (n[row] >= 5) if len(row) else np.zeros(0, bool)
        row, token, pos = row[keep], token[keep], pos[keep] if len(keep) else pos
        parts = 1 + weight[keep] // block if len(keep) else row
        cids = batch.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64)
        if probing:
            again = np.repeat(np.arange(len(row)), parts)
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            row, token, pos, cids = row[again], token[again], pos[again], cids[again]
        else:
            part = (_mix(cids.view(np.uint64), np.uint64(1)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64) if len(row) else parts
        token = np.where(part > 0, _mix(token, part.astype(np.uint64)), token)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(cids), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))], ["token", "cid", "n", "pos"])


def classes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their class, and the classes.

    Entries: ``entry_no``, ``train``, ``key`` (the class). Classes: ``cid`` (a number), ``key``, ``abbr``, ``words``, ``train``, ``eval`` (whether
    some member is in train, or not). Only classes with an abbreviation that occurs on both sides are kept.
    """
    text = F.concat_ws(" ", F.coalesce("context_before", F.lit("")), F.coalesce("context_after", F.lit("")))
    given = entries.select("entry_no", (F.coalesce("split", F.lit("")) == "train").alias("train"), "abbreviation", text.alias("text")).where("abbreviation IS NOT NULL AND abbreviation <> ''")
    keyed = given.select("entry_no", "train", term_key("abbreviation").alias("abbr"), _word_text()("text").alias("words")).where("abbr <> ''")
    keyed = materialize(keyed.withColumns({"key": F.unhex(F.md5(F.concat_ws("\u0001", "abbr", "words"))), "row": F.monotonically_increasing_id()}))
    both = keyed.groupBy("abbr").agg(F.min("train").alias("a"), F.max("train").alias("b")).where("a <> b").select("abbr")
    both = materialize(both)
    # The first row of a class stands for it, so that texts are read off that row instead of going through an aggregate.
    first = keyed.groupBy("key").agg(F.min("row").alias("row"), F.max("train").alias("train"), F.max(~F.col("train")).alias("eval"))
    live = keyed.select("abbr", "words", "row").join(broadcast_if_small(both), "abbr", "left_semi")
    found = live.join(first, "row").withColumnRenamed("row", "cid")
    return keyed.select("entry_no", "train", "key"), materialize(found)


def _word_text():
    from pyspark.sql.types import StringType

    return F.pandas_udf(lambda texts: pd.Series(word_text(texts.tolist())), StringType())


def class_pairs(found: DataFrame, hot: tuple[int, int] = HOT) -> DataFrame:
    """``eval_key``, ``train_key``: classes that agree, one with a member outside train and one with a member in it; equal ones too. ``hot``: see ``HOT``."""
    spark = found.sparkSession
    words = F.split("words", " ")
    cells = found.select(words.alias("words")).mapInArrow(_count_shingles, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SKETCH, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    sketch = spark.sparkContext.broadcast(counts)
    block = max(hot[1], hot[0] * int(counts.sum()) // max(1, int((counts > 0).sum())))

    def side(flag: str, name: str) -> DataFrame:
        probing = flag == "train"
        prefixes = found.where(flag).select("cid", words.alias("words"), "abbr").mapInArrow(lambda it: _prefixes(it, sketch, block, probing), "token long, cid long, n int, pos int")
        return prefixes.select("token", F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), F.col("pos").alias(f"p_{name}"))

    met = side("eval", "e").join(side("train", "t"), "token").where("e <> t")
    longer, shorter = F.greatest("n_e", "n_t"), F.least("n_e", "n_t")
    agree = F.ceil(longer * F.lit(SHARE[0]) / F.lit(SHARE[1]))
    # Shingles that must be shared, and those that still can be from these two positions on.
    must = longer - 1 - (longer - agree) * 2 - (shorter - agree)
    can = F.least(F.col("n_e") - 1 - F.col("p_e"), F.col("n_t") - 1 - F.col("p_t"))
    # The first shared shingle leaves room for all that must follow, each later one for one less.
    together = met.where((shorter >= agree) & (can >= must - EXTRA)).groupBy("e", "t").agg(F.count("*").alias("shared"), F.min(must).alias("must"))
    # Written, so that their number is known: where they are few, they go to the texts, and only texts that some pair names are shuffled.
    candidates = materialize(together.where(F.col("shared") >= F.least("must", F.lit(EXTRA + 1))).select("e", "t"))
    named = candidates.select(F.explode(F.array("e", "t")).alias("cid")).distinct()
    wanted = found.select("cid", "words", "key").join(broadcast_if_small(named), "cid", "left_semi")
    text = lambda name: wanted.select(F.col("cid").alias(name), F.col("words").alias(f"w_{name}"), F.col("key").alias(f"k_{name}"))
    judged = candidates.join(text("e"), "e").join(text("t"), "t").select("w_e", "w_t", F.col("k_e").alias("eval_key"), F.col("k_t").alias("train_key"))
    near = judged.mapInPandas(_verify, "eval_key binary, train_key binary")
    equal = found.where("train AND eval").select(F.col("key").alias("eval_key"), F.col("key").alias("train_key"))
    return near.unionByName(equal)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.loc[[_agree(a, b) for a, b in zip(pdf["w_e"], pdf["w_t"], strict=True)], ["eval_key", "train_key"]]


def cross_split_pairs(entries: DataFrame) -> DataFrame:
    """``entry_a``, ``entry_b``: entries that agree, one in train and one not, the smaller number first.

    Null contexts are empty; a null split is no train. An entry with a null or empty abbreviation, or one
    of characters without width only, agrees with none. Texts without any word agree with each other. A repeated row
    counts once; rows of one number with several texts are several entries, so their pairs can come more than once. Each pair of classes is verified once; the
    pairs of entries are its members', and a class with very many members is spread over several tasks.
    """
    members, found = classes(entries)
    pairs = materialize(class_pairs(found))
    keys = pairs.select(F.explode(F.array("eval_key", "train_key")).alias("key")).distinct()
    members = materialize(members.join(broadcast_if_small(keys), "key", "left_semi").distinct())
    of = lambda train, name: members.where(F.col("train") == train).select(F.col("key").alias(f"{name}_key"), F.col("entry_no").alias(name))
    half = spread_join(of(False, "eval"), pairs, "eval_key", "eval")
    joined = spread_join(half, of(True, "train"), "train_key", "eval")
    return joined.select(F.least("eval", "train").alias("entry_a"), F.greatest("eval", "train").alias("entry_b")).where("entry_a < entry_b")


def links(entries: DataFrame) -> DataFrame:
    """One row for each entry that has a link: ``entry_no``, ``split``, ``file``, ``n_links`` (entries on the other side that agree with it). A repeated row counts once."""
    members, found = classes(entries)
    members = members.distinct()
    sizes = members.groupBy("key").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval"))
    pairs = materialize(class_pairs(found))
    one = lambda mine, other, n: pairs.join(sizes.select(F.col("key").alias(other), n), other).groupBy(F.col(mine).alias("key")).agg(F.sum(n).alias("n_links"))
    to_train = members.where(~F.col("train")).join(one("eval_key", "train_key", "n_train"), "key")
    to_eval = members.where("train").join(one("train_key", "eval_key", "n_eval"), "key")
    about = entries.select("entry_no", "split", file_key(F.col("source.file")).alias("file")).distinct()
    return to_train.unionByName(to_eval).select("entry_no", "n_links").join(about, "entry_no").select("entry_no", "split", "file", "n_links")


def report(entries: DataFrame) -> DataFrame:
    """``split``, ``file``, ``entries``, ``links``: entries with an overlap and their links, by split and source file."""
    return links(entries).groupBy("split", "file").agg(F.count("*").alias("entries"), F.sum("n_links").alias("links"))
