"""Queries that write files and read them again: what comes back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import strip
from vellum.operators import dataset, decisions, replace
from vellum.operators import dictionary as d
from vellum.plans import dataset as dataset_plans
from vellum.plans import suggest as suggest_plans
from vellum.plans.tables import table
from vellum.sources import files, sinks
from vellum.storage import materialize, new_folder

_ENTRY = "entry_no long, abbreviation string, expansion string, context_before string, context_after string"


def _local(folder: str) -> str:
    """A path for what the driver writes by itself."""
    return folder.removeprefix("file://")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dataset_entries").select("entry_no", "abbreviation", "expansion", "context_before", "context_after")


def documents_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as an XML file, in a folder of its language label, beside one of the same name in another folder; scanned back from there with all folders below."""
    to = new_folder(spark)
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    given = table(spark, folder, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ("a", "b/c")))).alias("below"), safe.alias("safe"))
    made = given.select(F.concat(F.lit("/in/"), "below", F.lit("/"), "doc_id", F.lit(".xml")).alias("file_path"), F.concat(F.lit("<p>"), "below", F.lit(" "), "safe", F.lit("</p>")).alias("xml"))
    sinks.save_documents(made, to, "/in").write.format("noop").mode("overwrite").save()
    read = files.xml_files(spark, to)
    return read.select(F.regexp_extract("file_path", r"(\d+)\.xml$", 1).cast("long").alias("doc_id"), F.regexp_extract("file_path", r"/(a|b/c)/\d+\.xml$", 1).alias("below"), F.md5("xml").alias("digest"))


def dataset_array(spark: SparkSession, folder: str) -> DataFrame:
    """All entries as one JSON array, read back."""
    to = new_folder(spark)
    sinks.save_dataset(_entries(spark, folder), f"{_local(to)}/entries.json", "JSON")
    return spark.read.schema(_ENTRY).option("multiLine", True).json(f"{to}/entries.json")


def dataset_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All entries as a JSON object on each line, read back."""
    to = new_folder(spark)
    sinks.save_dataset(_entries(spark, folder), f"{to}/entries", "jsonl")
    return spark.read.schema(_ENTRY).json(f"{to}/entries")


def splits_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Entries in a folder for each split, read back with the split their folder names, and the formatted training records beside them."""
    to = new_folder(spark)
    parted = materialize(dataset.split(_entries(spark, folder), F.col("entry_no").cast("string")))
    train = parted.where("split = 'train' AND abbreviation IS NOT NULL")
    sinks.save_splits(parted, to, train.select("entry_no", dataset.chat_messages(train, dataset_plans.SYSTEM).alias("messages")))
    entries = spark.read.schema(f"{_ENTRY}, split string").json(f"{to}/entries")
    said = spark.read.schema("entry_no long, messages array<struct<role: string, content: string>>").json(f"{to}/train_formatted")
    return entries.select("entry_no", "split", "abbreviation").join(said.select("entry_no", F.element_at("messages", -1)["content"].alias("answer")), "entry_no", "left")


def decisions_saved(spark: SparkSession, folder: str) -> DataFrame:
    """The last decisions and the entries made of them, both saved under one moment and read back."""
    to = new_folder(spark)
    wanted = table(spark, folder, "user_decisions").select("abbr_key", "decision_no", "expansion", "context_before", "context_after", "abbreviation", "source", "confidence", "file_path", "decided_at", "loaded_at", "metadata")
    latest = materialize(decisions.latest_decisions(wanted))
    sinks.save_decisions(latest, decisions.decision_entries(latest), to, "20250101_000000")
    saved = spark.read.schema("abbr_key string, decision_no long, confidence double").json(f"{to}/user_decisions_20250101_000000")
    made = spark.read.schema("abbr_key string, abbreviation string, expansion string").json(f"{to}/datasets/expansion_dataset_20250101_000000").withColumnRenamed("abbr_key", "key")
    return saved.join(made, F.col("abbr_key").eqNullSafe(F.col("key"))).drop("key")


def log_saved(spark: SparkSession, folder: str) -> DataFrame:
    """The replacement log as saved and read back, and that every entry has the moment it was written."""
    to = new_folder(spark)
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("file_name"), "text")
    done = replace.run(documents, replace.steps(dataset_plans.DELETE, dataset_plans.REPLACE))
    sinks.save_log(replace.change_log(done), to)
    read = spark.read.schema("file_name long, line_number long, original string, replacement string, timestamp double").json(to)
    return read.select("file_name", "line_number", "original", "replacement", (F.col("timestamp") > 0).alias("timed"))


def dictionaries_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Both dictionaries saved as JSON objects in the order of their keys, and loaded again."""
    to = _local(new_folder(spark))
    given = table(spark, folder, "solution_dictionary").where("abbr IS NOT NULL")
    for name in ("user", "machine"):
        of = given.where(F.col("dict") == name).groupBy("abbr").agg(F.max_by("expansions", "key_ord").alias("expansions"), F.max("key_ord").alias("key_ord"))
        sinks.save_user_dictionary(f"{to}/{name}.json", of.withColumn("expansions", F.coalesce("expansions", F.array().cast("array<string>"))))
    loaded = files.load_dictionaries(spark, f"{to}/user.json", f"{to}/machine.json")
    return loaded.select("dict", F.col("key_ord").cast("long").alias("key_ord"), "abbr", F.array_join("expansions", "|").alias("expansions"))


def dictionary_updated(spark: SparkSession, folder: str) -> DataFrame:
    """The machine's dictionary as a file, laid over with the user's, as one file is by another, and with custom expansions saved for next time."""
    to = _local(new_folder(spark))
    both = table(spark, folder, "solution_dictionary")
    values = {name: {r["abbr"]: r["value"] for r in d.single_values(both, name).where("abbr IS NOT NULL").toLocalIterator()} for name in ("machine", "user")}
    sinks.write_json(f"{to}/merged.json", values["machine"])
    sinks.update_json(f"{to}/merged.json", values["user"])
    merged = [(k, "|".join(v)) for k, v in files.read_solutions(f"{to}/merged.json").items()]
    return spark.createDataFrame(merged, "abbr string, value string")


def custom_saved(spark: SparkSession, folder: str) -> DataFrame:
    """The user's dictionary with the custom expansions of all decisions, saved and loaded again."""
    to = _local(new_folder(spark))
    user = table(spark, folder, "solution_dictionary").where("dict = 'user'").groupBy("abbr").agg(F.max_by("expansions", "key_ord").alias("expansions"))
    additions = table(spark, folder, "user_decisions").where("source = 'custom'").select(F.col("abbr_key").alias("abbr"), strip(F.col("expansion")).alias("expansion"))
    sinks.save_user_dictionary(f"{to}/user.json", d.add_custom(user, additions))
    loaded = files.dictionary_frame(spark, files.read_solutions(f"{to}/user.json"), {})
    return loaded.select("abbr", F.array_join("expansions", "|").alias("expansions"))


QUERIES = {f.__name__: f for f in (documents_saved, dataset_array, dataset_lines, splits_saved, decisions_saved, log_saved, dictionaries_loaded, dictionary_updated, custom_saved)}

_ALL = "SELECT entry_no, abbreviation, expansion, context_before, context_after FROM dataset_entries"
SQL = {
    "documents_saved": """
        SELECT doc_id, below, md5('<p>' || below || ' ' || replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;') || '</p>') AS digest FROM documents, unnest(['a', 'b/c']) AS u(below)""",
    "dataset_array": _ALL,
    "dataset_lines": _ALL,
    "splits_saved": f"""
        WITH s AS ({dataset_plans.SQL['split_ratio']}) SELECT s.entry_no, s.split, e.abbreviation, CASE WHEN s.split = 'train' THEN replace(e.abbreviation, '$', 'n') END AS answer FROM s JOIN dataset_entries e ON e.entry_no = s.entry_no""",
    "decisions_saved": f"""
        WITH l AS ({dataset_plans.SQL['decisions_latest']}), a AS (SELECT decision_no, any_value(abbreviation) AS abbreviation FROM user_decisions GROUP BY 1)
        SELECT abbr_key, decision_no, confidence, coalesce(nullif(abbreviation, ''), abbr_key) AS abbreviation, expansion FROM l JOIN a USING (decision_no)""",
    "log_saved": f"SELECT *, TRUE AS timed FROM ({dataset_plans.SQL['replacement_log']})",
    "dictionaries_loaded": """
        WITH v AS (SELECT dict, abbr, arg_max(coalesce(expansions, []), key_ord) AS xs, max(key_ord) AS last_ord FROM solution_dictionary WHERE abbr IS NOT NULL GROUP BY ALL)
        SELECT dict, row_number() OVER (PARTITION BY dict ORDER BY last_ord, abbr) - 1 AS key_ord, abbr, array_to_string(xs, '|') AS expansions FROM v""",
    "dictionary_updated": suggest_plans.SQL["dict_merge"],
    "custom_saved": suggest_plans.SQL["dict_add_custom"],
}
