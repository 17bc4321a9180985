"""Texts of an Arrow batch as numpy arrays, and words and their hashes found in them without a loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def release() -> None:
    """Gives freed memory back to the system: a worker process lives on for other stages' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of all batches in runs of about ``limit`` text bytes (one row at least): the rows, the run's
    bytes, and where each row's bytes begin and end (one more than rows). Null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
    release()


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in order, and at which word each row begins (one more than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    here, before = inside[1:-1], inside[:-2].copy()
    before[at[:-1][at[:-1] < len(data)]] = False  # no word goes on from one row to the next
    starts = np.flatnonzero(here & ~before)
    after = inside[2:].copy()
    inner = at[1:][(at[1:] > 0) & (at[1:] <= len(data))]
    after[inner - 1] = False
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    inner = np.arange(int(lens.sum())) - np.repeat(first, lens)
    power = np.ones(int(lens.max()), np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    return mix(np.add.reduceat(_BYTE[data[inner + np.repeat(starts, lens)]] * power[inner], first) + lens.astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; the last k - 1 words begin none, and runs over two rows are the caller's to drop."""
    n = max(len(h) - k + 1, 0)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out + h[j : j + n]) * _GRAM
        out ^= out >> np.uint64(29)
    return mix(out)
