"""The pipelines behind the command line: expanding documents, building datasets, replacing characters, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.config import Config
from vellum.operators import dataset, decisions, replace, suggest, tei, xmlpatch
from vellum.operators import dictionary as dictionaries
from vellum.operators.providers import ChatProvider, SuggestionProvider, lemma_table
from vellum.operators.sizes import spread
from vellum.sources import files, sinks
from vellum.storage import materialize


def _language(config: Config) -> str:
    return str(config.get("document", "language", "latin")).lower()


def dictionary(spark: SparkSession, config: Config) -> DataFrame:
    return files.load_dictionaries(spark, str(config.resolve(config.get("data", "user_solution_path"))), str(config.resolve(config.get("data", "machine_solution_path"))))


def lemmas(spark: SparkSession, config: Config) -> DataFrame | None:
    """The lemmas for keys of one letter: those of the file ``data.lemmas_path``, without one WordNet's. None where ``settings.use_wordnet`` is off or there are no lemmas."""
    if not config.get("settings", "use_wordnet", True):
        return None
    path = config.optional("data", "lemmas_path")
    words = files.read_lemmas(config.resolve(path)) if path else files.wordnet_lemmas()
    return lemma_table(spark, words) if words else None


def provider(config: Config) -> SuggestionProvider | None:
    """The configured language model, where its keys are in the environment; else None, and offline answers are used."""
    section = "language_model_integration"
    if not config.get(section, "enabled", True):
        return None
    made = ChatProvider(str(config.get(section, "provider", "openai")).lower(), config.get(section, "model_name", "gpt-4"), count=int(config.get(section, "suggestion_count", 3)))
    return made if made.ready() else None


def add_custom(spark: SparkSession, config: Config, additions: list[tuple[str, str]]) -> bool:
    """Custom expansions (abbreviation, expansion) put into the user's dictionary file, for next time; whether that was saved."""
    path = config.resolve(config.get("data", "user_solution_path"))
    old = files.dictionary_frame(spark, files.read_solutions(path), {})
    new = dictionaries.add_custom(old, spark.createDataFrame(additions, "abbr string, expansion string"))
    return sinks.save_user_dictionary(path, new.join(old.select("abbr", "key_ord"), "abbr", "left"))


def conflicts(spark: SparkSession, config: Config) -> DataFrame:
    """``abbr``, ``machine_value``, ``user_value`` of keys that the two dictionary files give other values; those configured as ambiguous left out."""
    return dictionaries.conflicts(*_values(spark, config), config.ambiguous())


def _values(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    both = files.dictionary_frame(spark, *(files.read_or_create(config.resolve(config.get("data", key))) for key in ("user_solution_path", "machine_solution_path")))
    return dictionaries.single_values(both, "machine"), dictionaries.single_values(both, "user")


def resolve_conflicts(spark: SparkSession, config: Config, choices: list[tuple[str, str]]) -> bool:
    """Both dictionary files after choices (abbreviation, ``M`` or ``U``); whether both were saved."""
    asked = spark.createDataFrame(choices, "abbr string, choice string")
    made, saved = dictionaries.resolve(*_values(spark, config), asked, config.ambiguous()), True
    for key, new in zip(("machine_solution_path", "user_solution_path"), made, strict=True):
        path = config.resolve(config.get("data", key))
        order = files.dictionary_frame(spark, files.read_solutions(path), {}).select("abbr", "key_ord")
        values = new.select("abbr", F.split("value", r"\|").alias("expansions")).join(order, "abbr", "left")
        saved &= sinks.save_user_dictionary(path, values)
    return saved


def scan(spark: SparkSession, config: Config, path: str | list[str]) -> DataFrame:
    """Scanned documents of files or folders, kept so that no document is parsed twice."""
    documents = spread(files.xml_files(spark, path))
    return materialize(tei.scan_documents(documents, bool(config.get("settings", "process_g_elements", True))))


def suggested(spark: SparkSession, config: Config, scanned: DataFrame, with_context: bool = True) -> DataFrame:
    found = tei.abbreviations(scanned, normalize=bool(config.get("settings", "normalize_abbreviations", True)))
    if not with_context:  # looked up by the normalized form alone
        found = found.withColumns({c: F.lit("") for c in ("context_before", "context_after")}).withColumn("abbr_text", F.lit(None).cast("string"))
    use_model = bool(config.get("language_model_integration", "enabled", True))
    return suggest.suggestions(found, dictionary(spark, config), _language(config), lemmas=lemmas(spark, config), provider=provider(config), use_model=use_model)


def expand_documents(spark: SparkSession, config: Config, path: str, output: str) -> DataFrame:
    """Put the best suggestion into every document and save them by their paths below ``path``; ``file_path``, ``expanded``, ``error``, ``saved``. One that can't be parsed is saved as it was, with its error."""
    scanned = scan(spark, config, path)
    best = suggest.top(suggested(spark, config, scanned, with_context=False), "file_path", "kind_ord", "node_ord")
    patched = materialize(xmlpatch.patch_documents(files.xml_files(spark, path), best, use_choice=bool(config.get("xml_processing", "use_choice_tags", False)), add_ids=bool(config.get("xml_processing", "add_xml_ids", True)), pretty=True))
    unread = scanned.select("file_path", F.col("error").alias("unread"))
    about = patched.join(unread, "file_path").select("file_path", "expanded", F.coalesce("error", "unread").alias("error"))
    return about.join(sinks.save_documents(patched, output, path), "file_path")


def session_counts(found: DataFrame) -> DataFrame:
    """One row of a session: files with an abbreviation to expand, and abbreviations that got an expansion, every occurrence counted."""
    return found.agg(F.countDistinct("file_path").alias("files_processed"), F.count_if(F.size("suggestions") > 0).alias("abbreviations_expanded"))


def decide(spark: SparkSession, config: Config, path: str | list[str], choices: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Decisions for all abbreviations of a folder, or of ``found`` (from ``suggested``): the best suggestion of each, or what ``choices`` (``key``, ``choice``, ``custom``) says.

    ``key`` is ``file_path#node_ord`` of the element. Documents stay as they are.
    """
    found = (suggested(spark, config, scan(spark, config, path)) if found is None else found).withColumn("key", F.concat_ws("#", "file_path", "node_ord"))
    about = ("key", "file_path", "kind_ord", "node_ord", "abbr_text", "normalized_form", "context_before", "context_after", "metadata")
    if choices is None:
        made = suggest.top(found, *about)
    else:
        made = suggest.choose(found, choices, "key").join(found.select(*about), "key")
    placed = made.withColumn("at", F.struct("file_path", "kind_ord", "node_ord"))
    key = F.coalesce(F.nullif("abbr_text", F.lit("")), F.nullif("normalized_form", F.lit("")), F.concat(F.lit("unknown_"), "key"))
    kept = decisions.last_by_key(placed.withColumn("abbr_key", key).withColumn("abbreviation", F.col("abbr_text")), "abbr_key", ["at"])
    return kept.select("abbr_key", "expansion", "context_before", "context_after", "abbreviation", "source", "confidence", "file_path", "metadata")


def build_dataset(spark: SparkSession, config: Config, path: str, output: str, decided: DataFrame | None = None, system_message: str | None = None) -> DataFrame:
    """Entries of decisions, or of a new scan, split and saved; ``split``, ``n``. With ``dataset.format`` ``json`` each split is one array, too."""
    if decided is not None:
        given = decisions.decision_entries(decided).withColumn("id", F.md5("abbr_key"))
    else:
        least = int(config.get("validation", "minimum_context_length", 20))
        given = dataset.entries(tei.abbreviations(scan(spark, config, path)), str(config.get("dataset", "context_format", "separate")), bool(config.get("dataset", "include_metadata", True)), bool(config.get("validation", "validate_dataset", True)), least)
    key = F.to_json(F.struct("*"))
    stratum = config.optional("dataset", "stratify_by")
    parted = materialize(dataset.split(given, key, float(config.get("dataset", "train_ratio", 0.8)), float(config.get("dataset", "validation_ratio", 0.1)), stratum))
    train = parted.where("split = 'train'")
    template = str(config.get("dataset", "instruction_template", dataset.TEMPLATE))
    form = str(config.get("dataset", "format", "jsonl"))
    said = train.select(dataset.chat_messages(train, system_message, template, bool(config.get("dataset", "include_system_message", True))).alias("messages"))
    sinks.save_splits(parted, output, said)
    if form.lower() == "json":
        for part in ("train", "validation", "test"):
            sinks.save_dataset(parted.where(F.col("split") == part).drop("split"), f"{output}/{part}.json", form)
    return dataset.split_counts(parted)


def replace_characters(spark: SparkSession, config: Config, path: str, output: str) -> DataFrame:
    """Replace characters in all files of a folder and below, save texts by their paths below it, and a log by file, and return the summary. A missing section means no replacement."""
    section = "unicode_replacements"
    todo = replace.steps(config.optional(section, "characters_to_delete") or [], config.optional(section, "characters_to_replace") or {}, more_markers=config.optional(section, "additional_abbr_markers") or {})
    done = materialize(replace.run(files.text_files(spark, path), todo, "file_path", bool(config.optional(section, "replacements_on"))))
    saved = replace.whole_texts(done, "file_path").select("file_path", F.col("text").alias("xml"))
    sinks.save_documents(saved, f"{output}/texts", path).write.mode("overwrite").format("noop").save()
    log = replace.change_log(done, "file_path")
    sinks.save_log(log.withColumn("file_name", replace.basename(F.col("file_path"))), f"{output}/log")
    return replace.summary(log, "file_path")


def statistics(spark: SparkSession, config: Config, path: str) -> DataFrame:
    """``part``, ``metric``, ``value``: counts of documents and abbreviations, of the session, of suggestions, and of entries."""
    scanned = scan(spark, config, path)
    found = suggested(spark, config, scanned)
    entries = dataset.validation_counts(dataset.entries(tei.abbreviations(scanned), validate=False))
    parts = [("documents", tei.statistics(scanned)), ("session", session_counts(found)), ("suggestions", suggest.statistics(found)), ("entries", entries)]
    return reports(parts)


def reports(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """One-row frames of counts as rows of ``part``, ``metric``, ``value``."""
    rows = None
    for part, df in parts:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(part).alias("part"), F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in df.columns))).alias("x")).select("x.*")
        rows = long if rows is None else rows.unionByName(long)
    return rows
