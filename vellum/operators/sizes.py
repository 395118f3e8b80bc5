"""Broadcasting of what has been measured, and joins on keys that may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a table up to which it is sent to every executor.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64_000_000
#: Rows of one key that a task may take; keys with more are spread over several.
BLOCK = 1_000_000
_FOR_NULLS = 1000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes as text. No more than ``max_rows`` + 1 rows are looked at."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if ``is_small``, else as it is, so that joins shuffle it."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def spread_join(many: DataFrame, few: DataFrame, on: str, tell_apart: str, how: str = "inner", block: int = BLOCK) -> DataFrame:
    """``many`` joined with ``few`` on the column ``on``, where one key may hold a large share of ``many``'s rows.

    A small ``few`` is broadcast. Else keys with more than ``block`` rows are parted by the hash of the column
    ``tell_apart`` of ``many``, and their rows of ``few`` are repeated for each part, so that no task takes a whole key. Hot keys are at
    most one in ``block`` rows, which is what is broadcast to part them. Rows without a key are spread, too. ``how``: ``inner`` or ``left``.
    """
    if is_small(few):
        return many.join(F.broadcast(few), on, how)
    hot = F.broadcast(many.groupBy(on).agg(F.count("*").alias("__rows")).where(F.col("__rows") > block).select(on, F.ceil(F.col("__rows") / block).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    own = F.xxhash64(tell_apart)
    # Rows without a key meet none, so they may go anywhere.
    left = many.join(hot, on, "left").withColumn("__part", F.when(F.col(on).isNull(), F.pmod(own, F.lit(_FOR_NULLS))).otherwise(F.pmod(own, parts)).cast("int")).drop("__parts")
    right = few.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [on, "__part"], how).drop("__part")


def spread(source: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as there are cores, for work that takes far longer than reading its rows.

    A scan that already has as many, as any large one, is left alone. Only for plain scans: counting the partitions of
    a plan with a shuffle would run it.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    return source if source.rdd.getNumPartitions() >= cores else source.repartition(cores)
