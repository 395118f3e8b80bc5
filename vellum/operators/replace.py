"""Replacement of characters in lines of text, with a log of what was replaced where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import KEPT_ENDINGS, MARKERS

_LOG = "array<struct<original:string,replacement:string>>"


def lines(files: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``line_number`` from 1, ``line``: the lines of each text, however they end. A line end at the very end opens no line; null has none."""
    parts = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.where(F.col(text).isNotNull()).select(*keep, F.posexplode(parts).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_number"), "line")


def steps(delete: list[str] = (), replace: dict[str, str] | None = None, markers: bool = True, more_markers: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """What is looked for, what it becomes, and what the log says, in order: deletions, replacements, abbreviation markers."""
    found = [(c, "", "deleted") for c in delete] + [(a, b, b) for a, b in (replace or {}).items()]
    marks = {**dict(MARKERS), **dict(KEPT_ENDINGS), **(more_markers or {})} if markers else {}
    return found + [(a, b, b) for a, b in marks.items()]


def replaced(line: Column, todo: list[tuple[str, str, str]]) -> Column:
    """The line after all steps, each seeing what the last one left."""
    for old, new, _ in todo:
        line = F.replace(line, F.lit(old), F.lit(new))
    return line


def _any_of(line: Column, todo: list[tuple[str, str, str]]) -> Column:
    """Whether the line holds anything the steps look for, or could come to hold after one of them: characters that a step puts in count too."""
    single = {c for old, new, _ in todo for c in (old if len(old) == 1 else "") + (new if old != new else "")}
    longer = [old for old, _, _ in todo if len(old) > 1]
    quoted = ["\\x{%x}" % ord(c) for c in sorted(single)]
    parts = ([f"[{''.join(quoted)}]"] if quoted else []) + ["".join("\\x{%x}" % ord(c) for c in old) for old in longer]
    return line.rlike("|".join(parts))


def replaced_and_logged(line: Column, todo: list[tuple[str, str, str]]) -> Column:
    """Struct of ``line`` after all steps and ``log``, an entry for each step that found something.

    One fold over the steps, so that the expression doesn't grow with their square. A line that holds nothing the steps
    look for skips it.
    """
    none = F.struct(line.alias("line"), F.array().cast(_LOG).alias("log"))
    if not todo:
        return none
    given = F.array(*(F.struct(F.lit(a).alias("old"), F.lit(b).alias("new"), F.lit(c).alias("said")) for a, b, c in todo))

    def step(so_far: Column, s: Column) -> Column:
        entry = F.array(F.struct(s["old"].alias("original"), s["said"].alias("replacement")))
        hit = F.contains(so_far["line"], s["old"])
        return F.struct(F.replace(so_far["line"], s["old"], s["new"]).alias("line"), F.when(hit, F.concat(so_far["log"], entry)).otherwise(so_far["log"]).alias("log"))

    return F.when(_any_of(line, todo), F.aggregate(given, none, step)).otherwise(none)


def run(files: DataFrame, todo: list[tuple[str, str, str]], file: str = "file_name", on: bool = True) -> DataFrame:
    """``file``, ``line_number``, ``line``, ``log`` of every line; with ``on`` unset lines stay as they are and logs are empty."""
    return lines(files, [file]).withColumn("x", replaced_and_logged(F.col("line"), todo if on else [])).select(file, "line_number", "x.line", "x.log")


def replaced_lines(files: DataFrame, todo: list[tuple[str, str, str]], file: str = "file_name") -> DataFrame:
    """``file``, ``line_number``, ``line`` of every line after all steps, without a log."""
    return lines(files, [file]).select(file, "line_number", replaced(F.col("line"), todo).alias("line"))


def replaced_texts(files: DataFrame, todo: list[tuple[str, str, str]], file: str = "file_name") -> DataFrame:
    """``file``, ``text``: each text with its lines replaced, each ended by a line feed; null and empty texts give none.

    Same as ``whole_texts`` of ``run``. Steps without a line end can't reach over one, so texts are worked whole, without a shuffle; with
    such steps lines are worked apart and put together again.
    """
    if any("\n" in x or "\r" in x for old, new, _ in todo for x in (old, new)):
        return whole_texts(replaced_lines(files, todo, file), file)
    text = replaced(F.regexp_replace("text", r"\r\n?", "\n"), todo)
    return files.where("text <> ''").select(file, text.alias("text")).select(file, F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))).alias("text"))


def basename(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"[^/]*$", 0)


def change_log(done: DataFrame, file: str = "file_name") -> DataFrame:
    """``file``, ``line_number``, ``step`` (its order within the line), ``original``, ``replacement``: an entry for each step and line."""
    return done.select(file, "line_number", F.posexplode("log").alias("at", "e")).select(file, "line_number", (F.col("at") + 1).alias("step"), "e.original", "e.replacement")


def summary(log: DataFrame, file: str = "file_name") -> DataFrame:
    """One row: deletions, other replacements, and files with either."""
    return log.agg(F.count_if(F.col("replacement") == "deleted").alias("deleted"), F.count_if(F.col("replacement") != "deleted").alias("replaced"), F.countDistinct(file).alias("files"))


def whole_texts(done: DataFrame, file: str = "file_name") -> DataFrame:
    """``file``, ``text``: lines put together again, each ended by a line feed."""
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "line")))
    return done.groupBy(file).agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
