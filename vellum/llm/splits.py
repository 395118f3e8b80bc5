"""Train, validation and test splits that keep related records together.

Method: iterative minimum-label propagation over the bipartite graph of files and abbreviations, then
stratified assignment of whole groups that minimises how far each split's label distribution lies from
the intended one.

Files are numbered once, and labels are numbers. Propagation works on distinct edges only and contracts them: after a
round an edge carries the label of its file instead of the file, equal edges fall together, and an abbreviation all of
whose files bear one label is settled and dropped. Within a round labels are followed to their end by jumps that grow fourfold, so
that a long chain of files takes few rounds. Rounds end when no label changes. What each round did to the labels is a table in the
shared folder, and files go through these tables at the end; only row counts reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.lookalike import term_key
from vellum.operators.sizes import spread_join
from vellum.storage import materialize, materialize_counted, release

BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"
SPLITS = ("train", "validation", "test")


def file_key(path: Column) -> Column:
    """The name a file goes by: last part of its path, trimmed, lower case, without ``.xml``; null where nothing is left."""
    name = F.lower(F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), f"^{BLANK}+|{BLANK}+$", ""))
    name = F.regexp_replace(name, r"\.xml$", "")
    return F.when(name != "", name)


def ties(entries: DataFrame) -> DataFrame:
    """Distinct ``file``, ``abbr`` of entries that have both."""
    named = entries.select(file_key(F.col("source.file")).alias("file"), F.col("abbreviation").alias("abbr")).where("file IS NOT NULL AND abbr IS NOT NULL AND abbr <> ''")
    return named.distinct().select("file", term_key("abbr").alias("abbr")).where("abbr <> ''").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``file``, ``label`` (a number) of every file that shares an abbreviation with another, directly or through others: files tied have one label.

    ``edges``: ``file``, ``abbr``, repeated rows allowed. Files tied to no other are left out; an edge
    with a null ties nothing. No edges give no rows.
    """
    given = materialize(edges.where("file IS NOT NULL AND abbr IS NOT NULL").select("file", "abbr").distinct())
    files = materialize(given.select("file").distinct().withColumn("label", F.monotonically_increasing_id()))
    live = materialize(spread_join(given, files, "file", "abbr").select("label", "abbr"))
    release(given)
    steps = []
    while True:
        open_ = live.groupBy("abbr").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("abbr", "low")
        lower = live.join(open_, "abbr").groupBy("label").agg(F.min("low").alias("to")).where("to < label")
        step, seen = materialize_counted(lower, n=F.count("*"))
        if not seen["n"]:
            break
        steps.append(_roots(step))
        left = live.join(open_, "abbr", "left_semi").join(steps[-1].select("label", "to"), "label", "left")
        left = materialize(left.select(F.coalesce("to", "label").alias("label"), "abbr").distinct())
        release(live)
        live = left
    release(live)
    found, tied = files, step.select("to")
    for done in steps:
        found = found.join(done.select("label", "to"), "label", "left").select("file", F.coalesce("to", "label").alias("label"))
        tied = tied.unionByName(done.select("to"))
    # The label that a group ends with is one that some round led to.
    return found.join(tied.select(F.col("to").alias("label")).distinct(), "label", "left_semi").select("file", "label")


def _roots(step: DataFrame) -> DataFrame:
    """``label``, ``to`` with every pointer led to the label that points nowhere; each pass makes pointers reach four times as far, so chains end soon."""
    while True:
        one = step.select(F.col("label").alias("to"), F.col("to").alias("second"))
        two = step.select(F.col("label").alias("second"), F.col("to").alias("third"))
        three = step.select(F.col("label").alias("third"), F.col("to").alias("fourth"))
        far = step.select("label", "to").join(one, "to", "left").join(two, "second", "left").join(three, "third", "left")
        ahead, seen = materialize_counted(far.select("label", F.coalesce("fourth", "third", "second", "to").alias("to"), F.col("fourth").isNotNull().alias("on")), on=F.count_if("on"))
        release(step)
        step = ahead
        if not seen["on"]:
            return step


def propagate(edges: DataFrame) -> DataFrame:
    """``file``, ``label`` as ``components``, the label being the least file name of its group."""
    found = materialize(components(edges))
    return spread_join(found, found.groupBy("label").agg(F.min("file").alias("least")), "label", "file").select("file", F.col("least").alias("label"))


def tied_pairs(entries: DataFrame, block: int = 10_000) -> DataFrame:
    """``file_a``, ``file_b``: pairs of files that must share a split, the smaller name first.

    All pairs of a group are asked for, so their number grows with its square; ``tie_groups`` says the same with a row for each
    file. A group of more than ``block`` files is spread over as many tasks as it has blocks.
    """
    found = materialize(components(ties(entries)))
    pairs = spread_join(found.withColumnRenamed("file", "file_a"), found.withColumnRenamed("file", "file_b"), "label", "file_a", block=block)
    return pairs.where("file_a < file_b").select("file_a", "file_b")


def tie_groups(entries: DataFrame) -> DataFrame:
    """``file``, ``tie_group``, ``n_files``: each file that must share a split with others, the least name of its group, and the group's files."""
    found = materialize(components(ties(entries)))
    about = found.groupBy("label").agg(F.min("file").alias("tie_group"), F.count("*").alias("n_files"))
    return spread_join(found, about, "label", "file").select("file", "tie_group", "n_files")


def _assign(units: list[tuple[object, np.ndarray]], shares: np.ndarray) -> dict[object, int]:
    """Split of each unit, the largest first, each going where the summed squared deviation from the target grows least."""
    total = sum((v for _, v in units), np.zeros(units[0][1].shape))
    target = shares[:, None] * total[None, :]
    scale = np.maximum(total, 1.0)
    have = np.zeros_like(target)
    found = {}
    for key, v in sorted(units, key=lambda u: (-u[1].sum(), str(u[0]))):
        gap = (have - target) / scale
        # Growth of the squared deviation by label and of that by size.
        size_gap = (have.sum(1) - target.sum(1)) / scale.sum()
        w, ws = v / scale, v.sum() / scale.sum()
        cost = (2 * gap * w + w * w).sum(1) / len(scale) + 2 * size_gap * ws + ws * ws
        found[key] = s = int(np.argmin(cost))
        have[s] += v
    return found


def assign_splits(entries: DataFrame, label: Column, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), strata: int = 64, buckets: int = 4096, heavy_share: int = 1000) -> DataFrame:
    """``entry_no``, ``tie_group``, ``new_split`` for every entry.

    Entries of one file, and of files tied by a shared abbreviation, form a group and share a split. An
    entry without file is a group of its own. Null labels are one label; labels are hashed to ``strata``
    classes. No entries give no rows; repeated rows stay and fall in one split.

    What reaches the driver is bounded by the parameters: groups of more than one ``heavy_share``-th of all
    rows, fewer than ``heavy_share``, and the other groups summed into ``buckets`` by hash, each with at
    most ``strata`` counts. No group is ever cut.
    """
    spark = entries.sparkSession
    file = file_key(F.col("source.file"))
    stratum = F.when(label.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(label), F.lit(strata - 1))).cast("int")
    named = entries.select("entry_no", file.alias("file"), stratum.alias("stratum"))
    grouped = spread_join(named, propagate(ties(entries)), "file", "entry_no", "left").select("entry_no", "stratum", F.coalesce("label", "file", F.concat(F.lit("entry/"), F.col("entry_no").cast("string")), F.lit("entry/")).alias("tie_group"))
    grouped = materialize(grouped)
    total = grouped.count()
    sizes = grouped.groupBy("tie_group", "stratum").agg(F.count("*").alias("n"))
    heavy = [r[0] for r in sizes.groupBy("tie_group").agg(F.sum("n").alias("n")).where(F.col("n") * heavy_share > total).select("tie_group").collect()]
    heavy_df = F.broadcast(spark.createDataFrame([(g,) for g in heavy], "tie_group string"))
    bucket = F.pmod(F.xxhash64("tie_group"), F.lit(buckets)).cast("int")
    light = sizes.join(heavy_df, "tie_group", "left_anti").groupBy(bucket.cast("string").alias("unit"), "stratum").agg(F.sum("n").alias("n"))
    units: dict[tuple[bool, str], np.ndarray] = {}
    for kind, frame in ((True, sizes.join(heavy_df, "tie_group").select(F.col("tie_group").alias("unit"), "stratum", "n")), (False, light)):
        for unit, s, n in frame.collect():
            units.setdefault((kind, unit), np.zeros(strata))[s] += n
    placed = _assign(list(units.items()), np.array(shares)) if units else {}
    rows = {kind: [(u, SPLITS[s]) for (k, u), s in placed.items() if k is kind] for kind in (True, False)}
    by_group = F.broadcast(spark.createDataFrame(rows[True], "tie_group string, heavy_split string"))
    by_bucket = F.broadcast(spark.createDataFrame([(int(u), s) for u, s in rows[False]], "bucket int, bucket_split string"))
    joined = grouped.withColumn("bucket", bucket).join(by_group, "tie_group", "left").join(by_bucket, "bucket", "left")
    return joined.select("entry_no", "tie_group", F.coalesce("heavy_split", "bucket_split").alias("new_split"))


def balance(parted: DataFrame, label: str, shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """One row for each split: ``new_split``, ``entries``, ``share`` of all, ``deviation`` from the intended share, ``label_deviation``, the mean of that over labels by their
    rows, and ``parted_groups``, the groups found in more than one split (0 in any result of ``assign_splits``).

    ``parted``: ``tie_group``, ``new_split`` and the column ``label``. No rows give no rows.
    """
    wanted = F.create_map(*(F.lit(x) for pair in zip(SPLITS, map(float, shares), strict=True) for x in pair))
    counts = parted.groupBy(F.coalesce(label, F.lit("")).alias("label")).agg(F.count("*").alias("all"), *(F.count_if(F.col("new_split") == s).alias(s) for s in SPLITS))
    long = counts.select("all", F.explode(F.array(*(F.struct(F.lit(s).alias("new_split"), F.col(s).alias("n")) for s in SPLITS))).alias("x")).select("all", "x.*")
    off = F.abs(F.col("n") - F.col("all") * F.try_element_at(wanted, F.col("new_split")))
    found = long.groupBy("new_split").agg(F.sum("n").alias("entries"), (F.sum("n") / F.sum("all")).alias("share"), (F.sum(off) / F.sum("all")).alias("label_deviation"))
    torn = parted.groupBy("tie_group").agg(F.min("new_split").alias("a"), F.max("new_split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("parted_groups"))
    return found.withColumn("deviation", F.abs(F.col("share") - F.try_element_at(wanted, F.col("new_split")))).withColumn("parted_groups", F.lit(torn.first()[0]).cast("long"))
