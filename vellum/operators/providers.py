"""Sources of expansions beyond dictionaries and patterns: lemma tables and language models."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import prompt


class SuggestionProvider(Protocol):
    """Anything that answers prompts; it is pickled to the executors."""

    def answer(self, prompts: list[str]) -> list[str | None]:
        """The answer to each prompt, None where there is none."""


@dataclass(frozen=True)
class ChatProvider:
    """A service that completes chats (``openai``) or prompts (``mistral``, at the address of its environment variable); others raise. ``count`` expansions are asked for."""

    provider: str = "openai"
    model: str = "gpt-4"
    # Fixed value: what the model is told that it is.
    system_message: str = "You are an expert in early modern abbreviations."
    temperature: float = 0.7
    timeout: float = 30.0
    count: int = 3

    # The environment variables of each service's key and address, and the address of the first.
    VARIABLES = {"openai": ("OPENAI_API_KEY",), "mistral": ("MISTRAL_API_KEY", "MISTRAL_ENDPOINT")}
    CHAT = "https://api.openai.com/v1/chat/completions"

    def __post_init__(self) -> None:
        if self.provider not in self.VARIABLES:
            raise ValueError(f"unsupported provider: {self.provider}")

    def ready(self) -> bool:
        """Whether all that the service needs is in the environment."""
        return all(os.environ.get(v) for v in self.VARIABLES[self.provider])

    def request(self, text: str) -> urllib.request.Request:
        """The request for one prompt."""
        key, *address = (os.environ.get(v, "") for v in self.VARIABLES[self.provider])
        if self.provider == "mistral":
            body = {"prompt": text, "model": self.model, "num_outputs": 1, "temperature": self.temperature}
        else:
            messages = [{"role": "system", "content": self.system_message}] * bool(self.system_message) + [{"role": "user", "content": text}]
            body = {"model": self.model, "messages": messages, "n": 1, "temperature": self.temperature}
        return urllib.request.Request(address[0] if address else self.CHAT, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})

    def answer(self, prompts: list[str]) -> list[str | None]:
        found = []
        for text in prompts:
            try:
                with urllib.request.urlopen(self.request(text), timeout=self.timeout) as reply:
                    given = json.load(reply)
                found.append(given["outputs"][0] if self.provider == "mistral" else given["choices"][0]["message"]["content"])
            except (OSError, KeyError, IndexError, TypeError, ValueError):
                found.append(None)
        return found


def complete(records: DataFrame, provider: SuggestionProvider, count: int = 3) -> DataFrame:
    """``records`` with ``__answers``: what the provider says of ``lookup_key`` in its contexts, or the offline answers where it says nothing.

    Equal prompts are asked once: they are reduced to distinct ones, answered in Arrow batches, and joined back.
    """
    from vellum.functions.text import offline_expansions, parse_answer

    after = F.col("context_after") if "context_after" in records.columns else F.lit("")
    metadata = F.col("metadata") if "metadata" in records.columns else None
    asked = records.withColumn("__prompt", prompt(F.col("lookup_key"), F.col("context_before"), after, metadata, count))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"__prompt": pdf["__prompt"], "__answer": provider.answer(pdf["__prompt"].tolist())})

    answers = asked.select("__prompt").distinct().mapInPandas(run, "__prompt string, __answer string")
    parsed = F.when(F.col("__answer").isNotNull(), parse_answer(F.col("__answer"))).otherwise(offline_expansions(F.col("lookup_key")))
    return asked.join(answers, "__prompt").withColumn("__answers", parsed).drop("__prompt", "__answer")


def top_lemmas(lemmas: DataFrame, most: int = 3) -> DataFrame:
    """``__letter``, ``__lemmas``: for each letter the first ``most`` lemmas, in alphabetic order, that begin with it and have over two characters.

    Distinct lemmas are cut to the first few of each letter while they are combined, so a letter's group stays small.
    """
    letter = F.lower(F.substring("lemma", 1, 1))
    long = lemmas.where(F.length("lemma") > 2).select(letter.alias("__letter"), "lemma").distinct()
    from pyspark.sql import Window

    first = long.withColumn("rn", F.row_number().over(Window.partitionBy("__letter").orderBy("lemma"))).where(F.col("rn") <= most)
    return first.groupBy("__letter").agg(F.sort_array(F.collect_list("lemma")).alias("__lemmas"))


def lemma_table(spark, words: list[str]) -> DataFrame:
    """A lemma table of a list of words."""
    return spark.createDataFrame([(w,) for w in words], T.StructType([T.StructField("lemma", T.StringType())]))
