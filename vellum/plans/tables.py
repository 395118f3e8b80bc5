"""Reading the tables of a folder, and pieces of DuckDB SQL shared by the queries' checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.functions.text import MACRONS, OFFLINE_ANSWERS, RAISED, SIGNS, TILDES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
MACRON_TILDE = [*MACRONS, *TILDES]
REST = [*RAISED, *SIGNS]


def sql_text(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_answers() -> str:
    """The fixed offline answers as rows of word and answers."""
    rows = (f"({sql_text(word)}, [{', '.join(map(sql_text, answers))}])" for word, answers in OFFLINE_ANSWERS.items())
    return f"fixed(word, answers) AS (VALUES {', '.join(rows)})"


def sql_replace(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{BLANK}+'), lambda w: w <> '')"


def sql_period(x: str) -> str:
    return rf"regexp_replace({x}, '\.([a-z]{{2}})$', '$\1')"


def sql_markers(x: str) -> str:
    return sql_period(sql_replace(x, MACRON_TILDE + REST))
