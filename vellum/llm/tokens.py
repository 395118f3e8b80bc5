"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: tokenization automaton. The merges are compiled in order into a deterministic automaton over
token labels: one state for each label, the one reached by reading it. A merge of u and v applies one
gadget: the state of u loses its arc v; every state with an arc u gets an arc uv; the state of uv is a
copy of the state of v at that moment. States are kept as what they were copied from, and when, and
the arcs they lost since, so this part is as large as the list of merges. Paths of the finished automaton
are exactly the token sequences the merges produce, and each prefix of a word has one such path.

Words are read byte by byte, left to right, through a table of transitions by state and byte. A state of the byte
automaton is the label that the read prefix's path ends in, and the labels begun but not finished, each with the state it
began in. A transition is worked out at first use and then stands in the table; the labels of a word are those its states end in, from the last
one back. Decoding emits the arcs' labels.

The JVM splits texts into words, one Arrow batch encodes each of its distinct words once, and arrays
of ids are put together without Python touching single words.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.arrow import flat_words, ragged_take

DEFAULT_VOCABULARY = os.environ.get("VELLUM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
# Fixed value: how the public tokenizer parts a text into words, in Java's spelling of the blanks.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
_MOST_CACHED = 400_000
#: States of the byte automaton that a worker holds at most; beyond, its table is begun anew.
MOST_STATES = 200_000


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character that vocabulary files write it as: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The compiled automaton. Labels are numbered: bytes 0 to 255, then the merges in order."""

    def __init__(self, ids: list[int], merges: list[tuple[int, int]]):
        """``ids``: the tokenizer's id of each label. ``merges``: pairs of labels in order of priority."""
        self.ids = ids
        self.left, self.right = [-1] * 256, [-1] * 256
        self.bytes = [bytes([b]) for b in range(256)]
        self.lost: dict[tuple[int, int], int] = {}
        self._known: dict[tuple[int, int], bool] = {}
        labels = {self.bytes[b]: b for b in range(256)}
        live = [True] * 256
        for k, (u, v) in enumerate(merges, start=256):
            self.left.append(u)
            self.right.append(v)
            self.bytes.append(self.bytes[u] + self.bytes[v])
            # Else no word ever comes to this pair, as one of its parts is never made or never stands beside the other.
            if live[u] and live[v] and self._arc(u, v, k):
                self.lost.setdefault((u, v), k)
                labels[self.bytes[k]] = k
                live.append(True)
            else:
                live.append(False)
        self.labels = labels
        self.words: dict[str, list[int]] = {}
        self._trie: tuple[dict[int, int], list[int], list[bool]] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_table", "_states", "_number", "_last")} | {"words": {}, "_known": {}, "_trie": None}

    def _begin(self) -> None:
        """The trie of all labels (child by node and byte, label of each node, whether it has children), and an empty table."""
        if self._trie is None:
            child, label, inner = {}, [-1], [False]
            for raw, k in self.labels.items():
                node = 0
                for b in raw:
                    inner[node] = True
                    at = child.get(node << 8 | b)
                    if at is None:
                        at = child[node << 8 | b] = len(label)
                        label.append(-1)
                        inner.append(False)
                    node = at
                label[node] = k
            self._trie = child, label, inner
        # State 0: nothing read. Of each state the label it ends in, and pairs of a state and a node of the trie that may go on.
        self._states: list[tuple] = [((-1, 0),)]
        self._number: dict[tuple, int] = {}
        self._last: list[int] = [-1]
        self._table: dict[int, int] = {}

    def _arc(self, state: int, label: int, before: int) -> bool:
        """Whether the state has the arc, in the automaton made of the labels below ``before``."""
        while True:
            at = self.lost.get((state, label))
            if at is not None and at < before:
                return False
            if state < 256 and label < 256:
                return True
            if label > state:  # the label is the younger: it came to the states that then had its first part
                label, before = self.left[label], min(before, label + 1)
            else:  # the state is the younger: a copy of that of its second part
                state, before = self.right[state], min(before, state)

    def arc(self, state: int, label: int) -> bool:
        """Whether ``label`` may follow ``state`` in the finished automaton."""
        known = self._known.get((state, label))
        if known is None:
            if len(self._known) > 4 * _MOST_CACHED:
                self._known.clear()
            known = self._known[state, label] = self._arc(state, label, len(self.left))
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > _MOST_CACHED:
                self.words.clear()
            raw = word.encode("utf-8", "surrogatepass")
            found = self.words[word] = [self.ids[t] for t in self._path(raw)]
        return found

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte, entered in the table."""
        child, label, inner = self._trie
        last, on = -1, []
        for begun, node in self._states[state]:
            node = child.get(node << 8 | byte)
            if node is not None:
                k = label[node]
                if k >= 0 and (begun < 0 or self.arc(begun, k)):
                    last = k
                if inner[node]:
                    on.append((begun, node))
        key = (last, *on)
        to = self._number.get(key)
        if to is None:
            to = self._number[key] = len(self._states)
            self._states.append((*on, (last, 0)))
            self._last.append(last)
        self._table[state << 8 | byte] = to
        return to

    def _path(self, raw: bytes) -> list[int]:
        if self._trie is None or len(self._states) > MOST_STATES:
            self._begin()
        get, step, state, ends = self._table.get, self._step, 0, []
        for b in raw:
            to = get(state << 8 | b)
            state = step(state, b) if to is None else to
            ends.append(state)
        path, at = [], len(raw)
        while at:
            path.append(self._last[ends[at - 1]])
            at -= len(self.bytes[path[-1]])
        return path[::-1]

    def table_size(self) -> tuple[int, int]:
        """States and transitions of the byte automaton that stand in the table so far."""
        return (0, 0) if self._trie is None else (len(self._states), len(self._table))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by emitting the arcs' labels; ids of no label emit nothing."""
        if not hasattr(self, "_label_of"):
            self._label_of = {i: k for k, i in enumerate(self.ids)}
        return b"".join(self.bytes[self._label_of[i]] for i in ids if i in self._label_of).decode("utf-8", "replace")


def load_automaton(path: str = DEFAULT_VOCABULARY) -> TokenAutomaton:
    """Compile the automaton of a byte-level BPE vocabulary file (JSON with ``vocab`` and ``merges``)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, vocab = _byte_alphabet(), model["vocab"]
    number = {ch: b for ch, b in alphabet.items()}
    ids = [0] * 256
    for ch, b in alphabet.items():
        ids[b] = vocab[ch]
    merges = []
    for pair in model["merges"]:
        u, v = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((number[u], number[v]))
        number[u + v] = 256 + len(merges) - 1
        ids.append(vocab[u + v])
    return TokenAutomaton(ids, merges)


_LOADED: dict[tuple[str, str], object] = {}


def broadcast_automaton(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    """The automaton as a broadcast variable, made once for each application and file. Its size is that of the vocabulary, some 10 MB at most."""
    if os.path.getsize(path) > 64_000_000:
        raise ValueError(f"{path} is no vocabulary file: it has more than 64 MB")
    key = (spark.sparkContext.applicationId, path)
    if key not in _LOADED:
        _LOADED[key] = spark.sparkContext.broadcast(load_automaton(path))
    return _LOADED[key]


def _split(documents: DataFrame, keep: list[str]) -> DataFrame:
    words = F.coalesce(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))
    return documents.select(*keep, words.alias("words"))


def _encoded(automaton: TokenAutomaton, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows and the ids of all rows, one after another."""
    rows, codes, distinct = flat_words(words)
    found = [automaton.encode_word(w) for w in distinct]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths) - lengths
    flat = np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))
    at, ends = ragged_take(starts, lengths, codes)
    return np.concatenate([[0], ends])[rows], flat[at]


def encode(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids`` of every row's ``text``, without special tokens.

    A null or empty text gives an empty array; a blank text is encoded as it is; strings of special tokens
    are ordinary text. Repeated rows repeat. Texts are encoded whole, whatever their length. No shuffle.
    """
    automaton = broadcast_automaton(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ids = _encoded(automaton.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return _split(documents, ["doc_id"]).mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` of every row's ``text``; 0 for null and empty ones."""
    automaton = broadcast_automaton(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes, distinct = flat_words(batch.column(1))
            lengths = np.fromiter((len(automaton.value.encode_word(w)) for w in distinct), np.int64, len(distinct))
            ends = np.concatenate([[0], np.cumsum(lengths[codes])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends[rows[1:]] - ends[rows[:-1]], pa.int64())], ["doc_id", "n_tokens"])

    return _split(documents, ["doc_id"]).mapInArrow(run, "doc_id long, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``text`` of rows of ``doc_id``, ``ids``: the inverse of ``encode``. Null ids give null, empty ones ''."""
    automaton = broadcast_automaton(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else automaton.value.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
