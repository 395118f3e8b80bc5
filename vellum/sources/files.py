"""Reading XML and text files, and dictionaries."""

from __future__ import annotations

import json
import logging
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = "dict string, key_ord int, abbr string, expansions array<string>"
_MOST_BYTES = 256_000_000
_log = logging.getLogger("vellum.sources")


def xml_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file_path``, ``xml`` of files ending in ``.xml``, in these folders and all below. One row for each file."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
    return read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("xml"))


def text_files(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """``file_path``, ``text`` of files, whole, in these folders and all below."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def list_xml(folder: str) -> list[str]:
    """Paths of the ``.xml`` files of a local folder and all below, sorted."""
    return sorted(str(p) for p in Path(folder).rglob("*.xml") if p.is_file() and p.name.endswith(".xml"))


def list_documents(spark: SparkSession, path: str) -> list[str]:
    """Paths of the ``.xml`` files of a folder and all below, or the file itself, sorted; on any file system, names only."""
    if Path(path).is_file():
        return [path]
    if Path(path).is_dir():
        return list_xml(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    return sorted(r["path"] for r in found.select("path").toLocalIterator())


def pick(paths: list[str], spec: str) -> list[str]:
    """The paths that a list of numbers from 1, parted by commas, names. Numbers out of range are passed over; anything unreadable names the first."""
    try:
        numbers = [int(n) for n in spec.split(",")]
    except ValueError:
        return paths[:1]
    return [paths[n - 1] for n in numbers if 1 <= n <= len(paths)]


def read_solutions(path: str | Path) -> dict[str, list[str]]:
    """A dictionary file: an object of strings or lists. A missing, empty or unreadable one is empty."""
    file = Path(path)
    if not file.exists():
        _log.info("no dictionary %s", file)
        return {}
    if file.stat().st_size > _MOST_BYTES:
        raise ValueError(f"{file} is too large to be a dictionary")
    text = file.read_text(encoding="utf-8")
    try:
        found = json.loads(text) if text.strip() else {}
    except ValueError as e:
        _log.error("%s: %s", file, e)
        return {}
    return {k: [v] if isinstance(v, str) else [x for x in v if isinstance(x, str)] for k, v in found.items() if isinstance(v, str | list)} if isinstance(found, dict) else {}


def read_or_create(path: str | Path) -> dict[str, list[str]]:
    """As ``read_solutions``; a missing file is made, empty."""
    if not Path(path).exists():
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text("{}", encoding="utf-8")
    return read_solutions(path)


def dictionary_frame(spark: SparkSession, user: dict[str, list[str]], machine: dict[str, list[str]]) -> DataFrame:
    """Both dictionaries as one frame, with the order of their keys."""
    rows = [(name, i, k, v) for name, d in (("user", user), ("machine", machine)) for i, (k, v) in enumerate(d.items())]
    return spark.createDataFrame(rows, DICTIONARY)


def read_lemmas(path: str | Path) -> list[str]:
    """A lemma file: one lemma a line, blank lines passed over. A missing one is empty."""
    file = Path(path)
    if not file.exists():
        _log.warning("no lemmas %s", file)
        return []
    if file.stat().st_size > _MOST_BYTES:
        raise ValueError(f"{file} is too large to be a lemma file")
    return [w for line in file.read_text(encoding="utf-8").splitlines() if (w := line.strip())]


def wordnet_lemmas(synsets: int = 100) -> list[str]:
    """Lemmas of WordNet's first noun ``synsets``, without those that begin with a capital, if NLTK and its corpus are installed; else none."""
    try:
        from nltk.corpus import wordnet

        names = [name for s in islice(wordnet.all_synsets("n"), synsets) for name in s.lemma_names()]
    except (ImportError, LookupError):
        _log.warning("no WordNet; keys of one letter get no lemmas")
        return []
    return [name for name in names if name[:1] == name[:1].lower()]


def load_dictionaries(spark: SparkSession, user_path: str, machine_path: str) -> DataFrame:
    """The two dictionary files as a frame."""
    return dictionary_frame(spark, read_solutions(user_path), read_solutions(machine_path))
