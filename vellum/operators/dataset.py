"""Training entries: projection, validation, deduplication, splitting and chat formatting."""

from __future__ import annotations

import math
import random
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import combined_context, entry_id, instruction, not_empty, placeholder
from vellum.operators import pick
from vellum.operators.sizes import broadcast_if_small, is_small
from vellum.storage import materialize

# Fixed value: the instruction that training records give.
TEMPLATE = "Expand the abbreviation: {abbr} in context: {context}"
#: Digits of the hash that a rank is first counted by: 4,096 classes.
_RANK_DIGITS = 3
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_PLACE_BITS = 33
#: Places whose parts are told by one number, and places packed at a time.
_WORD = 32
_PACKED = 1 << 20


def sufficient_context(before: Column, after: Column, least: int = 20) -> Column:
    """Whether either context has at least ``least`` characters; null ones have none."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return (size(before) >= least) | (size(after) >= least)


def entries(records: DataFrame, context_format: str = "separate", include_metadata: bool = True, validate: bool = True, min_context: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries of scanned abbreviations: ``abbreviation``, ``id``, the context as one column or two, ``source``, ``metadata``.

    With ``validate``, records with too little context on both sides are left out. The id is the element's, else
    one made of text and path. Which columns there are is settled by the parameters, not by the data.
    """
    rows = records.where(sufficient_context(F.col("context_before"), F.col("context_after"), min_context)) if validate else records
    before, after = F.coalesce("context_before", F.lit("")), F.coalesce("context_after", F.lit(""))
    context = [before.alias("context_before"), after.alias("context_after")] if context_format == "separate" else [combined_context(before, F.col("abbr_text"), after).alias("context")]
    source = F.struct(F.col("file_path").alias("file"), "xpath", F.col("line_number").alias("line")).alias("source")
    known = F.coalesce(not_empty(F.col("abbr_id")), entry_id(F.col("abbr_text"), F.col("file_path"))).alias("id")
    return rows.select(*keep, F.col("abbr_text").alias("abbreviation"), known, *context, source, *(["metadata"] if include_metadata else []))


def with_required(given: DataFrame) -> DataFrame:
    """Entries that have an abbreviation."""
    return given.where(F.col("abbreviation").isNotNull())


def first_by_id(given: DataFrame, position: str) -> DataFrame:
    """The first entry, by ``position``, of each id; entries without id count as one with an empty id. A repeated row counts once."""
    return pick.by_key(given.withColumn("__id", F.coalesce("id", F.lit(""))), "__id", [position]).drop("__id")


def validate(given: DataFrame, position: str, check_duplicates: bool = True) -> DataFrame:
    """Entries with an abbreviation, each id once. An entry without abbreviation doesn't use up its id."""
    good = with_required(given)
    return first_by_id(good, position) if check_duplicates else good


def validation_counts(given: DataFrame) -> DataFrame:
    """One row: all entries, those skipped for want of an abbreviation, and duplicates."""
    has = F.col("abbreviation").isNotNull()
    distinct = F.count_distinct(F.when(has, F.coalesce("id", F.lit(""))))
    return given.agg(F.count("*").alias("total_entries"), F.count_if(~has).alias("skipped_entries"), (F.count_if(has) - distinct).alias("duplicate_entries"))


def ranked_by_hash(rows: DataFrame, key: Column, stratum: Column | None = None) -> DataFrame:
    """``rows`` with ``__rn``, the exact place from 1 of each in the order of its key's hash, and ``__n``, their number; within each stratum.

    Ranked in two steps, without ever sorting all rows in one task: rows are counted by the first digits of the
    hash, the sums before each class are its offset, and only classes are sorted. ``key`` must tell rows apart.
    """
    hashed = rows.withColumn("__h", F.md5(key)).withColumn("__s", F.lit("") if stratum is None else F.coalesce(stratum.cast("string"), F.lit("default"))).withColumn("__b", F.substring("__h", 1, _RANK_DIGITS))
    # Written, so that rows are counted once for both the size check and the offsets.
    sizes = materialize(hashed.groupBy("__s", "__b").agg(F.count("*").alias("__size")))
    along = Window.partitionBy("__s").orderBy("__b")
    offsets = sizes.withColumn("__before", F.sum("__size").over(along) - F.col("__size")).withColumn("__n", F.sum("__size").over(Window.partitionBy("__s"))).drop("__size")
    sent = F.broadcast(offsets) if is_small(sizes) else offsets
    within = Window.partitionBy("__s", "__b").orderBy("__h")
    placed = hashed.withColumn("__at", F.row_number().over(within)).join(sent, ["__s", "__b"])
    return placed.withColumn("__rn", F.col("__before") + F.col("__at")).drop("__h", "__b", "__before", "__at", "__s")


def split(rows: DataFrame, key: Column, train: float = 0.8, validation: float = 0.1, stratify_by: str | None = None, derived: Column | None = None) -> DataFrame:
    """``rows`` with ``split``: of n the first int(n * train) in hash order are train, the next int(n * validation) validation, the rest test.

    ``stratify_by`` splits each of its values on its own, if there is such a column; else nothing is stratified.
    ``derived`` stratifies by an expression. A null stratum is ``default``.
    """
    stratum = derived if derived is not None else F.col(stratify_by) if stratify_by and stratify_by in rows.columns else None
    placed = ranked_by_hash(rows, key, stratum)
    return _cut(placed, train, validation)


def _cut(placed: DataFrame, train: float, validation: float) -> DataFrame:
    n_train = F.floor(F.col("__n") * F.lit(float(train)))
    n_validation = F.floor(F.col("__n") * F.lit(float(validation)))
    part = F.when(F.col("__rn") <= n_train, "train").when(F.col("__rn") <= n_train + n_validation, "validation").otherwise("test")
    return placed.withColumn("split", part).drop("__rn", "__n")


def _placed(rows: DataFrame, position: str) -> tuple[DataFrame, int]:
    """``rows`` with ``__p``, the exact place from 0 of each in the order of ``position``, without it last, then of the content's hash; and their number.

    Ranges are sorted apart, and the sizes of those before are a range's offset, so no task sorts all rows; only rows alike in every column are never parted.
    """
    order = [F.col(position).asc_nulls_last(), F.xxhash64(*rows.columns).asc()]
    # Written, since the bounds of ranges are sampled anew each time. The id holds the range, and in its last bits the place within.
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__id", _PLACE_BITS))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size")).orderBy("__range").collect()
    *before, n = accumulate((x["__size"] for x in sizes), initial=0)
    offsets = rows.sparkSession.createDataFrame([(x["__range"], k) for x, k in zip(sizes, before, strict=True)], "__range long, __before long")
    placed = ranged.join(F.broadcast(offsets), "__range").withColumn("__p", F.col("__before") + F.col("__id").bitwiseAND((1 << _PLACE_BITS) - 1))
    return placed.drop("__range", "__id", "__before"), n


def _shuffled_parts(n: int, trained: int, validated: int, seed: int) -> Iterator[pa.RecordBatch]:
    """``__word``, ``__parts``: for each 32 of ``n`` places, two bits a place from the lowest, 0 where Python's shuffle brings it before ``trained``, 1 before ``validated``, else 2.

    The shuffle exchanges each place, from the last down, with one drawn up to it. Undone in reverse order, its exchanges bring the parts
    from the shuffled places back to the first ones; those within train change no part. So it takes a byte for each place and a number for each that isn't in train.
    """
    draw = random.Random(seed).getrandbits
    drawn = array("I" if n <= 1 << 32 else "Q")
    least = max(trained, 1)
    for i in range(n - 1, least - 1, -1):
        bits = (i + 1).bit_length()
        j = draw(bits)
        while j > i:
            j = draw(bits)
        drawn.append(j)
    parts = bytearray(-(-n // _WORD) * _WORD)
    parts[trained:validated] = b"\1" * (validated - trained)
    parts[validated:n] = b"\2" * (n - validated)
    for i, j in enumerate(reversed(drawn), least):
        parts[i], parts[j] = parts[j], parts[i]
    shifts = np.arange(0, 2 * _WORD, 2, dtype=np.uint64)
    for start in range(0, len(parts), _PACKED):
        some = np.frombuffer(parts, np.uint8, min(_PACKED, len(parts) - start), start).reshape(-1, _WORD)
        words = np.bitwise_or.reduce(some.astype(np.uint64) << shifts, axis=1).view(np.int64)
        first = start // _WORD
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(words))), pa.array(words)], ["__word", "__parts"])


def split_shuffled(rows: DataFrame, position: str, train: float = 0.8, validation: float = 0.1, seed: int = 42, most: int | None = None) -> DataFrame:
    """As ``split``, in the order that Python's generator with ``seed`` shuffles rows into that stand in the order of ``position``.

    Gaps in ``position`` count for nothing; rows alike in it stand in the order of their content's hash, those without it come last. Each draw of the generator
    depends on those before, so one task makes all of them, and of its parts two bits a row are sent. More than ``most`` rows raise ValueError, if it is given.
    """
    if most is not None and (count := rows.count()) > most:
        raise ValueError(f"{count} rows; the shuffled order is made for at most {most}")
    placed, n = _placed(rows, position)
    n_train, n_validation = math.floor(n * float(train)), math.floor(n * float(validation))
    trained = min(max(n_train, 0), n)
    validated = min(max(n_train + n_validation, trained), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from _shuffled_parts(n, trained, validated, seed)

    words = materialize(rows.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "__word long, __parts long"))
    joined = placed.withColumn("__word", F.expr(f"__p div {_WORD}")).join(broadcast_if_small(words), "__word")
    code = F.expr(f"shiftright(__parts, cast(__p % {_WORD} * 2 AS int)) & 3")
    part = F.when(code == 0, "train").when(code == 1, "validation").otherwise("test")
    return joined.withColumn("split", part).drop("__word", "__parts", "__p")


def split_counts(parted: DataFrame) -> DataFrame:
    """``split``, ``n``: entries of each split."""
    return parted.groupBy("split").agg(F.count("*").alias("n"))


def chat_messages(given: DataFrame, system_message: str | None = None, template: str = TEMPLATE, include_system: bool = True) -> Column:
    """Messages of a chat that trains on an entry: the system's, if any, the instruction, and the abbreviation with ``$`` as ``n``.

    The context is the entry's own, else both contexts around the abbreviation.
    """
    composed = combined_context(F.col("context_before"), F.col("abbreviation"), F.col("context_after")) if "context_before" in given.columns else F.lit("")
    context = F.coalesce(not_empty(F.col("context")), composed) if "context" in given.columns else composed
    said = [("system", F.lit(system_message))] if include_system and system_message else []
    said += [("user", instruction(template, abbr=F.col("abbreviation"), context=context)), ("assistant", placeholder(F.col("abbreviation")))]
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said))
