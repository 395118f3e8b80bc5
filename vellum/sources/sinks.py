"""Writing entries, decisions, dictionaries, documents and logs."""

from __future__ import annotations

import json
import logging
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_log = logging.getLogger("vellum.sinks")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)")


def write_atomic(path: str | Path, pieces: Iterable[str]) -> bool:
    """Write text beside the target and rename it there, so that no reader sees half a file. False, and a log entry, where that fails."""
    target = Path(path)
    name = None
    try:
        target.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=target.parent, prefix=".writing-", delete=False) as f:
            name = f.name
            f.writelines(pieces)
        os.replace(name, target)
        return True
    except OSError as e:
        _log.error("%s: %s", target, e)
        if name and os.path.exists(name):
            os.unlink(name)
        return False


def write_json(path: str | Path, value: object, indent: int = 2) -> bool:
    """A value as JSON, characters as they are."""
    return write_atomic(path, [json.dumps(value, ensure_ascii=False, indent=indent)])


def update_json(path: str | Path, new: dict) -> bool:
    """A JSON object with ``new`` laid over what is there; a missing or unreadable file counts as empty."""
    try:
        old = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        old = {}
    return write_json(path, (old if isinstance(old, dict) else {}) | new)


def save_array(df: DataFrame, path: str, order: str | None = None) -> bool:
    """One file with a JSON array of the rows. Rows pass through the driver one partition at a time; for large results ``save_lines`` is meant."""

    def pieces() -> Iterator[str]:
        yield "["
        rows = (df.orderBy(order) if order else df).select(F.to_json(F.struct("*")).alias("x")).toLocalIterator()
        for i, row in enumerate(rows):
            yield ("," if i else "") + "\n" + json.dumps(json.loads(row["x"]), ensure_ascii=False, indent=2)
        yield "\n]\n"

    return write_atomic(path, pieces())


def save_lines(df: DataFrame, folder: str, single: bool = False) -> None:
    """A JSON object on each line, written by all tasks, or into one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(folder)


def save_dataset(df: DataFrame, path: str, form: str = "json") -> bool:
    """As an array or as lines, by ``form`` in any case; other forms raise ValueError."""
    if form.lower() not in ("json", "jsonl"):
        raise ValueError(f"unknown format: {form}")
    if form.lower() == "json":
        return save_array(df, path)
    save_lines(df, path)
    return True


def save_splits(parted: DataFrame, folder: str, formatted: DataFrame | None = None) -> None:
    """Entries in a folder for each split, and formatted training records beside them."""
    parted.write.mode("overwrite").partitionBy("split").json(f"{folder}/entries")
    if formatted is not None:
        formatted.write.mode("overwrite").json(f"{folder}/train_formatted")


def save_decisions(decided: DataFrame, entries: DataFrame, folder: str, stamp: str) -> None:
    """Decisions, and the entries made of them, each under a name with the moment. ``decided`` is read twice, so it should be a table."""
    decided.write.mode("overwrite").json(f"{folder}/user_decisions_{stamp}")
    entries.write.mode("overwrite").json(f"{folder}/datasets/expansion_dataset_{stamp}")


def below(path: str, root: str) -> str:
    """A file's path, as Spark gives it, relative to the folder ``root`` it was read from; where ``root`` is the file itself, its name. A file elsewhere keeps its whole path."""
    whole = unquote(_SCHEME.sub("", path))
    start = os.path.normpath(_SCHEME.sub("", root)) if _SCHEME.match(root) else os.path.abspath(root)
    if whole == start:
        return os.path.basename(whole)
    start = start.rstrip("/") + "/"
    return whole[len(start) :] if whole.startswith(start) else whole.lstrip("/")


def write_whole(folder: str, name: str, text: str) -> bool:
    """A text as a file of a folder, on any file system that its URI names: written beside the target and moved there. False, and a log entry, where that fails.

    A folder without a scheme, or with ``file``, is one of this machine, or mounted on it.
    """
    if not _SCHEME.match(folder) or folder.startswith("file:"):
        return write_atomic(Path(unquote(_SCHEME.sub("", folder))) / name, [text])
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    try:
        system, root = fs.FileSystem.from_uri(folder)
        target = f"{root.rstrip('/')}/{name}"
        system.create_dir(os.path.dirname(target), recursive=True)
        beside = f"{os.path.dirname(target)}/.writing-{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as out:
            out.write(text.encode("utf-8"))
        system.move(beside, target)
        return True
    except (OSError, pa.ArrowException) as e:
        _log.error("%s/%s: %s", folder, name, e)
        return False


def save_documents(patched: DataFrame, folder: str, root: str | None = None) -> DataFrame:
    """Write each document (``file_path``, ``xml``) into a shared folder, named by a path or a URI; ``file_path``, ``saved`` of each.

    Named by its path below ``root``, the folder that was read, so that files of one name in several folders stay apart;
    without ``root`` by its name alone.

    Written where the rows are, each file whole at once, so a task that runs again leaves the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [x is not None and write_whole(folder, os.path.basename(p) if root is None else below(p, root), x) for p, x in zip(pdf["file_path"], pdf["xml"], strict=True)]
            yield pd.DataFrame({"file_path": pdf["file_path"], "saved": done})

    return patched.select("file_path", "xml").mapInPandas(run, "file_path string, saved boolean")


def save_log(log: DataFrame, folder: str) -> None:
    """A replacement log with the moment it is written."""
    log.withColumn("timestamp", F.unix_timestamp(F.current_timestamp()).cast("double")).write.mode("overwrite").json(folder)


def save_user_dictionary(path: str | Path, dictionary: DataFrame) -> bool:
    """A dictionary (``abbr``, ``expansions``) as a JSON object in the order of ``key_ord``, keys without one, or all where there is no such column, after those in the order of the alphabet."""
    order = [F.col("key_ord").asc_nulls_last(), "abbr"] if "key_ord" in dictionary.columns else ["abbr"]
    return write_json(path, {r["abbr"]: list(r["expansions"]) for r in dictionary.orderBy(*order).toLocalIterator()}, indent=4)
