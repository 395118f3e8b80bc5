"""Documents as they arrive in a folder: an extension, for nothing in the batch pipelines is a stream.

Every file is scanned once, and decisions are kept up to date in a table: of those with one key the last wins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import decisions, suggest, tei

DECISION = "abbr_key string, expansion string, confidence double, source string, file_path string, seen_at timestamp, node_ord int"


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """``file_path``, ``xml`` of XML files as they arrive."""
    read = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    return read.load(folder).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("seen_at"), F.col("value").alias("xml"))


def decided(batch: DataFrame, dictionary: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Decisions of a batch of documents; keys of one letter take ``lemmas`` (``lemma``) where they are given."""
    found = suggest.suggestions(tei.abbreviations(tei.scan_documents(batch)), dictionary, lemmas=lemmas)
    best = suggest.top(found, "file_path", "node_ord", "abbr_text", "normalized_form").join(batch.select("file_path", "seen_at"), "file_path")
    key = F.coalesce(F.nullif("abbr_text", F.lit("")), F.nullif("normalized_form", F.lit("")), F.concat(F.lit("unknown_"), "file_path", F.lit("#"), F.col("node_ord").cast("string")))
    return best.select(key.alias("abbr_key"), "expansion", "confidence", "source", "file_path", "seen_at", "node_ord")


def upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """The last decision of each key, of those there and new ones."""
    both = current.unionByName(new)
    return decisions.last_by_key(both, "abbr_key", ["seen_at", "file_path", "node_ord"]).select(*new.columns)


def current_decisions(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The decisions in a table's newest finished version, or the newest before a batch; none where there is none."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    path = path_of(f"{table}/versions")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(path_of(s.getPath(), "_SUCCESS"))) if fs.exists(path) else []
    names = [n for n in names if before is None or int(n) < before]
    return spark.read.schema(DECISION).parquet(f"{table}/versions/{names[-1]}") if names else spark.createDataFrame([], DECISION)


def run(spark: SparkSession, folder: str, table: str, dictionary: DataFrame, checkpoint: str, once: bool = True, lemmas: DataFrame | None = None) -> StreamingQuery:
    """Keep a table of decisions for the documents that arrive in a folder, with ``lemmas`` (``pipelines.lemmas``) for keys of one letter.

    Each batch writes a new version of the table, named by the batch's number, so a batch that is run again after a failure
    gives the same version and a reader never sees half of one.
    """

    def batch(df: DataFrame, number: int) -> None:
        earlier = current_decisions(dictionary.sparkSession, table, number)
        upsert(earlier, decided(df, dictionary, lemmas)).write.mode("overwrite").parquet(f"{table}/versions/{number:012d}")

    writer = arriving(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(f"documents-{uuid.uuid4().hex[:8]}")
    return (writer.trigger(availableNow=True) if once else writer).start()
