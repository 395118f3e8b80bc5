"""One row of each key, the first or the last in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(rows: DataFrame, key: str, order: list[str], last: bool = False, first_order: str | None = None) -> DataFrame:
    """The row of each ``key`` that is first in ``order``, or ``last``; with ``first_order``, a struct of that name with the order of the first.

    A null key is a key. Rows alike in ``order`` are told apart by a hash of their content, rows alike in everything
    are one. Null orders come first.

    Only the order and two hashes of each row are aggregated, combined before the shuffle, so a key with a large share of the
    rows is a few narrow rows; the rows chosen are then found by their hashes, which no key makes uneven.
    """
    content = rows.columns
    marked = rows.withColumns({"__h": F.xxhash64(*content), "__g": F.xxhash64(F.lit(1), *content)})
    place = F.struct(*order, "__h", "__g")
    wanted = [(F.max if last else F.min)(place).alias("__at")]
    if first_order:
        wanted.append(F.min(F.struct(*order)).alias(first_order))
    chosen = marked.groupBy(key).agg(*wanted).select("__at.__h", "__at.__g", *([first_order] if first_order else []))
    found = marked.join(chosen, ["__h", "__g"], "inner" if first_order else "left_semi")
    return found.select(*content, "__h", "__g", *([first_order] if first_order else [])).distinct().drop("__h", "__g")
