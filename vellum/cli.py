"""Command line: ``python -m vellum.cli``."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.config import Config, ConfigError, missing_keys, setup_logging
from vellum.functions.text import CONFIDENCE, display_token, normalize_abbreviation, truncate
from vellum.operators import decisions, suggest
from vellum.plans import pipelines
from vellum.session import local_session
from vellum.sources import files, sinks
from vellum.storage import materialize

MENU = ["Process documents", "Expand a word", "Build a dataset", "Statistics", "Settings", "Leave"]
_MADE = "abbr_key string, expansion string, context_before string, context_after string, abbreviation string, source string, confidence double, file_path string, metadata map<string,string>"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="vellum", description="Expansion of abbreviations in early printed texts")
    parser.add_argument("-c", "--config", default="config.toml", help="configuration file")
    parser.add_argument("-i", "--input", help="folder of TEI files, instead of the configured one")
    parser.add_argument("-o", "--output", help="folder for results, instead of the configured one")
    parser.add_argument("-q", "--quiet", action="store_true", help="ask nothing")
    parser.add_argument("-v", "--verbose", action="store_true", help="log more")
    parser.add_argument("-p", "--process", help="one TEI file to expand")
    parser.add_argument("--conflicts", action="store_true", help="ask about keys that the two dictionaries give other values, and save both")
    return parser.parse_args(argv)


def word_suggestions(spark: SparkSession, config: Config, word: str, context: str = "") -> tuple[str, list[tuple[str, float, str]]]:
    """The written form of one word, and its suggestions, best first, none of a single character."""
    row = spark.createDataFrame([(word, context, "")], "abbr_text string, context_before string, context_after string").withColumn("normalized_form", normalize_abbreviation(F.col("abbr_text")))
    asked = pipelines.provider(config)
    found = suggest.suggestions(row, pipelines.dictionary(spark, config), pipelines._language(config), lemmas=pipelines.lemmas(spark, config), provider=asked)
    best = suggest.ranked(suggest.without_single_letters(found, always=True), "normalized_form").orderBy("rank").collect()
    return row.first()["normalized_form"], [(r["expansion"], r["confidence"], r["source"]) for r in best]


def expand_word(spark: SparkSession, config: Config, word: str) -> list[tuple[str, float, str]]:
    """Suggestions for one word, best first, none of a single character."""
    return word_suggestions(spark, config, word)[1]


class Session:
    """What one person does from start to leave: decisions, and counts of files and expansions."""

    def __init__(self, spark: SparkSession, config: Config, source: str, output: str, ask: Callable[[str], str] = input, say: Callable[[str], None] = print):
        self.spark, self.config, self.source, self.output, self.ask, self.say = spark, config, source, output, ask, say
        self.decided: DataFrame | None = None
        self.typed: list[tuple] = []
        self.files_processed = self.abbreviations_expanded = 0

    def _yes(self, question: str) -> bool:
        return self.ask(f"{question} [y/n] ").strip().lower() in ("y", "yes")

    def _keep(self, made: DataFrame) -> None:
        """Lay decisions over those of the session; of one key the later one counts."""
        if self.decided is None:
            self.decided = materialize(made)
            return
        both = self.decided.withColumn("turn", F.lit(0)).unionByName(made.withColumn("turn", F.lit(1)))
        self.decided = materialize(decisions.last_by_key(both, "abbr_key", ["turn"]).drop("turn", "first_order"))

    def _keep_typed(self) -> None:
        """What was typed since, in the order typed."""
        if not self.typed:
            return
        last = {row[0]: row for row in self.typed}
        made = self.spark.createDataFrame(list(last.values()), _MADE)
        meta = F.struct(*(F.try_element_at("metadata", F.lit(m)).alias(m) for m in pipelines.tei.META))
        self._keep(made.withColumn("metadata", meta))
        self.typed = []

    def choose_files(self) -> list[str]:
        """All documents, or those whose numbers are given."""
        found = files.list_documents(self.spark, self.source)
        if not found:
            self.say("no XML files")
            return []
        self.say(f"{len(found)} XML files")
        if self._yes("Process all files?"):
            return found
        for i, path in enumerate(found, 1):
            self.say(f"{i}. {sinks.below(path, self.source)}")
        return files.pick(found, self.ask("Numbers, parted by commas: ").strip() or "1")

    def process(self) -> None:
        """Decide the abbreviations of documents, by asking or by the best suggestion."""
        chosen = self.choose_files()
        if not chosen:
            return
        if self.config.get("user_interface", "interactive_mode", True):
            for path in chosen:
                self.ask_about(path)
            self._keep_typed()
        else:
            found = materialize(pipelines.suggested(self.spark, self.config, pipelines.scan(self.spark, self.config, chosen)))
            self._keep(pipelines.decide(self.spark, self.config, chosen, found=found))
            counts = pipelines.session_counts(found).first()
            self.files_processed += counts["files_processed"]
            self.abbreviations_expanded += counts["abbreviations_expanded"]
        self.say(f"{self.files_processed} files processed, {self.abbreviations_expanded} expansions")

    def ask_about(self, path: str) -> None:
        """Ask about each abbreviation of one document, in its order: a number, c for another expansion, s to skip. Custom expansions go to the user's dictionary."""
        found = suggest.without_single_letters(pipelines.suggested(self.spark, self.config, pipelines.scan(self.spark, self.config, path)))
        by_rank = F.transform(F.array_sort(F.transform("suggestions", lambda s, i: F.struct((-F.coalesce(s["confidence"], F.lit(-1.0))).alias("o"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
        shown = found.select("number", "of", "kind", "xpath", "abbr_text", "normalized_form", "context_before", "context_after", "file_path", "metadata", "kind_ord", "node_ord", by_rank.alias("suggestions"), display_token(F.col("abbr_text")).alias("token"), display_token(F.col("normalized_form"), shorten=True).alias("short"))
        any_found, custom = False, []
        # One document's abbreviations, one after another, as the person answers.
        for r in shown.orderBy("kind_ord", "node_ord").toLocalIterator():
            any_found = True
            self.say(f"{r['number']}/{r['of']}: {r['token'] or 'Unknown'} (<{r['kind']}>), looked up as {r['short']}, at {r['xpath']}")
            self.say(f"{r['context_before']} {r['token'] or 'Unknown'} {r['context_after']}")
            for i, s in enumerate(r["suggestions"], 1):
                self.say(f"{i}. {s['expansion']}  {s['confidence']:.2f}  {s['source']}")
            choice = self.ask("A number, c for another expansion, s to skip: ").strip().lower()
            if choice.isdigit() and 1 <= int(choice) <= len(r["suggestions"]):
                s = r["suggestions"][int(choice) - 1]
                made = (s["expansion"], s["source"], s["confidence"])
            elif choice == "c" and len(text := self.ask("Expansion: ").strip()) > 1:
                if r["abbr_text"]:
                    custom.append((r["abbr_text"], text))
                made = (text, "custom", CONFIDENCE["custom"])
            else:
                self.say("skipped")
                continue
            key = r["abbr_text"] or r["normalized_form"] or f"unknown_{len(self.typed)}"
            self.typed.append((key, made[0], r["context_before"], r["context_after"], r["abbr_text"], made[1], made[2], r["file_path"], r["metadata"].asDict() if r["metadata"] else None))
            self.abbreviations_expanded += 1
        self.files_processed += any_found
        if custom:
            pipelines.add_custom(self.spark, self.config, custom)

    def expand_words(self) -> None:
        """Suggestions for words as they are typed; the answer is an expansion, c for a custom one that the user's dictionary keeps, or s to skip."""
        while (word := self.ask("Word, or nothing to go back: ").strip()) and word.lower() != "exit":
            context = self.ask("Context, if any: ").strip()
            form, found = word_suggestions(self.spark, self.config, word, context)
            if form != word:
                self.say(f"looked up as {form}")
            if not found:
                self.say("no suggestions")
                continue
            for expansion, confidence, origin in found:
                self.say(f"{expansion[:47] + '...' if len(expansion) > 50 else expansion}  {confidence:.2f}  {origin}")
            answer = self.ask("The expansion, c for a custom one, s to skip: ").strip()
            source = "manual"
            if answer.lower() == "c":
                answer, source = self.ask("Expansion: ").strip(), "custom"
                if len(answer) < 2:
                    answer = ""
                else:
                    pipelines.add_custom(self.spark, self.config, [(word, answer)])
            if not answer or source == "manual" and answer.lower() == "s":
                self.say("skipped")
                continue
            self.typed.append((word, answer, context, "", word, source, CONFIDENCE[source], "", {}))
        self._keep_typed()

    def build(self) -> None:
        for row in pipelines.build_dataset(self.spark, self.config, self.source, f"{self.output}/datasets", self.decided).collect():
            self.say(f"{row['split']}: {row['n']}")

    def statistics(self) -> None:
        for row in pipelines.statistics(self.spark, self.config, self.source).where("part <> 'session'").collect():
            self.say(f"{row['part']} {row['metric']}: {row['value']}")
        self.say(f"session files_processed: {self.files_processed}")
        self.say(f"session abbreviations_expanded: {self.abbreviations_expanded}")

    def settings(self) -> None:
        for section, key, value in self.config.recap():
            self.say(f"{section}.{key} = {value}")

    def conflicts(self) -> None:
        """Ask whose value each conflicting key keeps, and save both dictionaries."""
        choices = []
        for r in pipelines.conflicts(self.spark, self.config).orderBy("abbr").toLocalIterator():
            answer = self.ask(f"{r['abbr']}: M for {r['machine_value']}, U for {r['user_value']}, S to skip: ").strip().upper()
            if answer in ("M", "U"):
                choices.append((r["abbr"], answer))
            elif answer != "S":
                self.say("skipped")
        saved = pipelines.resolve_conflicts(self.spark, self.config, choices)
        self.say(f"{len(choices)} conflicts resolved" if saved else "could not be saved")

    def leave(self) -> None:
        """Save decisions, and the entries made of them, if that is wanted."""
        if self.decided is not None and self._yes("Save your work?"):
            stamp = time.strftime("%Y%m%d_%H%M%S")
            sinks.save_decisions(self.decided, decisions.decision_entries(self.decided), self.output, stamp)
            self.say(f"{self.decided.count()} decisions")


def menu(spark: SparkSession, config: Config, source: str, output: str, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> Session:
    """Choices until the last one."""
    session = Session(spark, config, source, output, ask, say)
    todo = {"1": session.process, "2": session.expand_words, "3": session.build, "4": session.statistics, "5": session.settings}
    while True:
        say("\n".join(f"{i}. {m}" for i, m in enumerate(MENU, 1)))
        choice = ask("Choice: ").strip()
        if choice == "6":
            session.leave()
            return session
        if choice in todo:
            todo[choice]()


def main(argv: list[str] | None = None) -> int:
    """Run; 0 where that went well, else 1."""
    args = arguments(argv)
    try:
        config = Config(args.config)
        config.validate_paths(args.process or args.input, args.output)
    except (FileNotFoundError, ConfigError, KeyError) as e:
        print(e, file=sys.stderr)
        return 1
    setup_logging(level=10 if args.verbose else 20)
    for warning in missing_keys(config):
        print(warning, file=sys.stderr)
    source = args.process or args.input or str(config.resolve(config.get("paths", "input_path")))
    output = args.output or str(config.resolve(config.get("paths", "output_path")))
    spark = local_session("*")
    if args.conflicts:
        Session(spark, config, source, output).conflicts()
        return 0
    if args.quiet:
        report = materialize(pipelines.expand_documents(spark, config, source, output))
        counts = report.agg(F.count("*").alias("files"), F.coalesce(F.sum("expanded"), F.lit(0)).alias("expansions"), F.count_if(~F.col("saved") | F.col("error").isNotNull()).alias("failed")).first()
        print(f"{counts['files']} files, {counts['expansions']} expansions, {counts['failed']} failed")
        for row in report.where(~F.col("saved") | F.col("error").isNotNull()).select("file_path", truncate(F.coalesce("error", F.lit("not saved")), 200).alias("why")).limit(20).collect():
            print(f"{row['file_path']}: {row['why']}", file=sys.stderr)
        return int(counts["failed"] > 0)
    menu(spark, config, source, output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
