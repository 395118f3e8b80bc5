"""Shared handling of Arrow batches whose rows hold arrays of words split by the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row offsets, code of each word, and the distinct words, of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.dictionary_encode(column.values.slice(offsets[0], offsets[-1] - offsets[0]))
    return offsets - offsets[0], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def ragged_take(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs that ``codes`` name, one after another, and where each run ends.

    Run k covers ``starts[k]`` to ``starts[k] + lengths[k]``.
    """
    n = lengths[codes]
    ends = np.cumsum(n)
    shift = starts[codes] - (ends - n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, n), ends


def portions(column: pa.Array, most: int = 400_000) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of a list column with about ``most`` words each, so that what is worked out for each word has a bound. A longer text is a part by itself."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        stop = min(stop, len(column))
        yield start, stop - start
        start = stop
