"""Filling containers of fixed capacity with texts.

Method: bound-certified repacking. Items are spread over partitions and each is packed by best-fit
decreasing. Dual-feasible-function lower bounds say how many containers a partition needs at least;
where the packing meets the bound it is certified as optimal. Partitions with a gap exchange
documents in pairs, the one with the widest gap with the one with the narrowest: what lies in their containers with room is put
together and packed again by best-fit decreasing, and kept so where it takes no more containers than before. The pair then parts the containers anew, the
fullest to one of them, so that room left over gathers in the other and the first can be certified. This repeats until no gap is left, or until a
round neither saves a container nor certifies a partition.

Only sizes and row numbers travel, never texts, and a partition holds a bounded number of containers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.tokens import count_tokens
from vellum.operators.sizes import MAX_BROADCAST_ROWS
from vellum.storage import materialize, release

_PACKED = "row_id long, piece int, size long, part int, bin int, bins int, bound int"
#: Containers that items without size are dealt to at most.
_FOR_EMPTY = 4096


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container of each item, and their number: largest item first, each into the fullest container with room.

    Containers are stacked by the room left in them, so an item looks only at rooms.
    """
    order = np.argsort(-sizes, kind="stable")
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some container has room r
    where = np.empty(len(sizes), np.int32)
    n = 0
    for i in order.tolist():
        size = int(sizes[i])
        fitting = filled >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            b = room_of[room].pop()
            if not room_of[room]:
                filled &= ~(1 << room)
        else:
            b, room, n = n, capacity, n + 1
        where[i] = b
        room_of[room - size].append(b)
        filled |= 1 << (room - size)
    return where, n


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs, by two families of dual-feasible functions.

    A dual-feasible function maps sizes so that whatever fits one container still does; the mapped total, in
    containers and rounded up, is then a bound. Family one, for a threshold t up to half the capacity: sizes above
    capacity - t count as the whole, those below t as nothing. Family two, for k: a size s counts as floor((k + 1) s / capacity) / k of
    a container, where (k + 1) s is no multiple of the capacity.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    s = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.cumsum(count * s), np.cumsum(count)
    best = -(-int(mass[-1]) // capacity)
    t = np.arange(0, capacity // 2 + 1)
    middle = mass[capacity - t] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    best = max(best, int((-(-(middle + (number[-1] - number[capacity - t]) * capacity) // capacity)).max()))
    for k in range(1, 60):
        scaled = (k + 1) * s
        value = np.where(scaled % capacity == 0, s * k, (scaled // capacity) * capacity)  # in capacity * k
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return max(best, 1)


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["row_id", "piece"], ignore_index=True)
    sizes = pdf["size"].to_numpy(np.int64)
    where, n = best_fit_decreasing(sizes, capacity)
    return pdf.assign(bin=where, bins=n, bound=lower_bound(sizes, capacity))[["row_id", "piece", "size", "part", "bin", "bins", "bound"]]


def _exchange(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Two partitions, or one left over, after an exchange of what lies in containers with room.

    The pair's containers are numbered anew, the fullest first; the partition of the lower number gets as many of them as it had or, if containers were saved, those
    that are left.
    """
    pdf = pdf.sort_values(["row_id", "piece"], ignore_index=True)
    parts = sorted(pdf["part"].unique())
    sizes = pdf["size"].to_numpy(np.int64)
    bins = np.unique(np.stack([pdf["part"].to_numpy(np.int64), pdf["bin"].to_numpy(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)
    fill = np.bincount(bins, sizes).astype(np.int64)
    loose = fill[bins] < capacity
    kept = len(fill) - len(np.unique(bins[loose]))
    where, n = best_fit_decreasing(sizes[loose], capacity)
    if kept + n <= len(fill):
        bins[~loose] = np.unique(bins[~loose], return_inverse=True)[1].reshape(-1)
        bins[loose] = kept + where
        fill = np.bincount(bins, sizes).astype(np.int64)
    rank = np.empty(len(fill), np.int64)
    rank[np.argsort(-fill, kind="stable")] = np.arange(len(fill))
    bins = rank[bins]
    first = -(-len(fill) // len(parts))
    part = np.where(bins < first, parts[0], parts[-1])
    pdf = pdf.assign(part=part, bin=np.where(bins < first, bins, bins - first), bins=0, bound=0)
    for p in parts:
        mine = part == p
        if mine.any():
            pdf.loc[mine, "bins"] = int(pdf.loc[mine, "bin"].max()) + 1
            pdf.loc[mine, "bound"] = lower_bound(sizes[mine], capacity)
    return pdf[["row_id", "piece", "size", "part", "bin", "bins", "bound"]]


def _per_part(packed: DataFrame) -> DataFrame:
    return packed.groupBy("part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))


def _state(packed: DataFrame) -> tuple[int, int, int]:
    """Partitions that don't meet their bounds, their containers, and those of all partitions."""
    open_ = F.col("bins") > F.col("bound")
    return tuple(_per_part(packed).agg(F.count_if(open_), F.coalesce(F.sum(F.when(open_, F.col("bins"))), F.lit(0)), F.coalesce(F.sum("bins"), F.lit(0))).first())


def _partners(packed: DataFrame, n: int) -> DataFrame:
    """The ``n`` partitions that don't meet their bounds, each with the pair it exchanges in."""
    # One row for each partition, not for each item, so one task can rank them.
    ranked = _per_part(packed.where("bins > bound")).withColumn("at", F.row_number().over(Window.orderBy(F.col("bound") - F.col("bins"), "part")))
    found = ranked.select("part", F.least(F.col("at") - 1, F.lit(n) - F.col("at")).cast("int").alias("pair"))
    return F.broadcast(found) if n <= MAX_BROADCAST_ROWS else found


def pack_parts(items: DataFrame, capacity: int, per_part: int) -> list[tuple[DataFrame, str]]:
    """Packed items (``row_id``, ``piece``, ``size``, ``part``, ``bin``, ``bins``, ``bound``) in frames, each with the prefix of its containers' names: those certified by the
    first packing and by each exchange, and last those that no exchange could certify. Items without size are not taken."""
    parts = max(1, -(-items.count() // per_part))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("row_id", "piece"), F.lit(parts)).cast("int"))
    packed = materialize(dealt.groupBy("part").applyInPandas(lambda pdf: _pack(pdf, capacity), _PACKED))
    found, turn = [(packed.where("bins = bound"), "0")], 0
    n, bins, _ = _state(packed)
    while n > 1:
        pairs = packed.where("bins > bound").join(_partners(packed, n), "part")
        again = materialize(pairs.groupBy("pair").applyInPandas(lambda pdf: _exchange(pdf, capacity), _PACKED))
        n_now, bins_open, bins_now = _state(again)
        if n_now == n and bins_now >= bins:
            release(again)
            break
        turn += 1
        found.append((again.where("bins = bound"), str(turn)))
        packed, n, bins = again, n_now, bins_open
    return [*found, (packed.where("bins > bound"), str(turn))]


def pack(sizes: DataFrame, capacity: int = 1024, per_part: int = 20_000) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``size``, ``container``, ``certified`` of every item.

    ``sizes``: ``doc_id``, ``n_tokens``; further columns are ignored. An item above the capacity is cut into pieces of the
    whole capacity, each a container of its own, and a last piece; ``start`` is a piece's first token. Other items have
    one piece. Empty items, and those of null size, take no room and are dealt to containers that are there anyway, or one of their own where there is none. Repeated
    rows are packed each. No rows give no rows. ``certified``: the container's partition meets its lower bound, as does any whole piece.

    Row numbers are dealt before packing, in a written table, so a repeated key can't gather in one partition,
    and ``per_part`` bounds what a partition holds at first; an exchange parts the containers of two partitions evenly.
    """
    numbered = materialize(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).withColumn("row_id", F.monotonically_increasing_id()))
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    name = F.concat_ws("-", F.lit("w"), "row_id", "piece")
    whole = numbered.where(F.col("n_tokens") > capacity).select("row_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece")).select("row_id", "piece", F.lit(capacity).cast("long").alias("size"), name.alias("container"), F.lit(True).alias("certified"))
    rest = numbered.select("row_id", F.when(F.col("n_tokens") > capacity, full).otherwise(0).alias("piece"), F.when(F.col("n_tokens") > capacity, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens")).alias("size"))
    done = pack_parts(rest.where("size > 0"), capacity, per_part)
    named = [packed.select("row_id", "piece", "size", F.concat_ws("-", F.lit(turn), "part", "bin").alias("container"), (F.col("bins") == F.col("bound")).alias("certified"), "bin") for packed, turn in done]
    found = reduce(DataFrame.unionByName, [df.drop("bin") for df in named], whole)
    # The first container of each partition, of these the same few whatever the number of empty items; where there are only whole pieces, theirs.
    firsts = reduce(DataFrame.unionByName, [df.where("bin = 0") for df in named]).select("container", "certified").distinct().orderBy(F.xxhash64("container"))
    some = [r[:] for r in firsts.limit(_FOR_EMPTY).collect() or whole.select("container", "certified").limit(_FOR_EMPTY).collect()] or [("0-0-0", True)]
    into = F.broadcast(numbered.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(some)], "at int, container string, certified boolean"))
    empty = numbered.where("n_tokens = 0").select("row_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("size"), F.pmod(F.xxhash64("row_id"), F.lit(len(some))).cast("int").alias("at")).join(into, "at").drop("at")
    found = found.unionByName(empty)
    return found.join(numbered.select("doc_id", "row_id"), "row_id").select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("start"), "size", "container", "certified")


def pack_documents(documents: DataFrame, capacity: int = 1024, per_part: int = 20_000) -> DataFrame:
    """Containers for the texts of ``documents``, measured in tokens."""
    return pack(count_tokens(documents), capacity, per_part)


def fill_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: items, containers, containers any packing needs by size alone, those of partitions that meet their bound, and the share of room left unused."""
    bins = packed.groupBy("container").agg(F.sum("size").alias("size"), F.count("*").alias("items"), F.min("certified").alias("certified"))
    return bins.agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.ceil(F.sum("size") / capacity).alias("least"), F.count_if("certified").alias("certified"), (1 - F.sum("size") / (F.count("*") * capacity)).alias("unused"))


def kept_whole(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """``doc_id``, ``one_piece`` (or as few as a text above the capacity needs), ``in_room`` (its containers hold no more than they can) of every document that a row is packed of."""
    room = packed.groupBy("container").agg((F.sum("size") <= capacity).alias("fits"))
    tokens = F.sum("size")
    return packed.join(room, "container").groupBy("doc_id").agg((F.count("*") == F.greatest(F.lit(1), F.ceil(tokens / capacity))).alias("one_piece"), F.min("fits").alias("in_room"))
