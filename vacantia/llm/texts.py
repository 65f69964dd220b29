"""Vectorised text pieces for Arrow batches: bounded slices, words, and words as dictionary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20

WORD = r"[^\x20\x09-\x0D]+"


def slices(batches, column: str = "text", target: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `target` bytes of `column`, so that working memory doesn't depend on the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // target
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def filled(column) -> pa.Array:
    """A text column with nulls as empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column, "")


def list_parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column without empty strings, and how many each row has."""
    flat = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not full.all():
        row = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(row[full], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(full))
    return flat, counts


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in order, and the number in each text."""
    texts = pc.ascii_lower(texts) if lower else texts
    return list_parts(pc.ascii_split_whitespace(texts))


def coded(flat: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct strings and the code of each occurrence."""
    d = flat.dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)


def indexed(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As `coded`, with the distinct strings as an Arrow array."""
    d = flat.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of `values` over consecutive runs of `counts` (0 for empty runs)."""
    ends = np.cumsum(counts)
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[ends] - total[ends - counts]


def within(counts: np.ndarray, width: int) -> np.ndarray:
    """True at each position from which `width` items of the same run follow, itself included."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(int(counts.sum()))
    return left >= width
