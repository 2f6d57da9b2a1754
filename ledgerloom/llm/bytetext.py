"""Vectorised numpy work on the UTF-8 bytes of Arrow string arrays.

Everything here runs inside Spark tasks. Texts are cut into slices of about
128 KB (a longer text is a slice of its own), so memory follows the slice,
never the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between ASCII white space (tab to carriage return, blank).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False

#: Bytes of lower-cased alphanumeric words: a-z, 0-9, and all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
ALNUM[65:91] = True  # A-Z, as a-z

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        steps = np.full(size, _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", len(data))[: len(data)], out=self.sums[1:])
        self.down = _power("down", len(data) + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, beside the JVM in one memory limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
    if len(data) > most:
        give_back()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of True, and where each row's runs begin among them.

    A run never crosses the border between two rows.
    """
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    full = offsets[1:] > offsets[:-1]
    opens[first[full]] = inside[first[full]]
    closes[last[full]] = inside[last[full]]
    begin = np.flatnonzero(opens)
    return begin, np.flatnonzero(closes) + 1, np.searchsorted(begin, offsets)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words of a flat array (rows not regarded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _STEP + words[j : j + n]
    return mix(total + np.uint64(k))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and where each row's words begin."""
    low = LOWER[data]
    begin, end, rows = spans(table[low], offsets)
    return (SpanHash(low)(begin, end) if len(begin) else np.zeros(0, np.uint64)), rows


def by_row(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """An order of items, rearranged so that rows follow each other; within a row it is kept."""
    own = rows[order]
    if len(own) and own.max() < 1 << 16:
        own = own.astype(np.uint16)  # numpy sorts these by radix
    return order[np.argsort(own, kind="stable")]


def distinct_shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of every row, flat, and where each row's begin.

    A row with fewer than k words has its whole sequence as its only shingle.
    """
    counts = np.diff(rows)
    at = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
    begin = np.repeat(rows[:-1] - np.concatenate(([0], np.cumsum(np.maximum(counts - k + 1, 0))))[:-1], np.maximum(counts - k + 1, 0)) + np.arange(len(at))
    values = grams(words, k)[begin] if len(begin) else np.zeros(0, np.uint64)
    for short in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[rows[short] : rows[short + 1]]
        values, at = np.append(values, grams(own, len(own))), np.append(at, short)
    order = by_row(at, np.argsort(values))
    values, at = values[order], at[order]
    if len(values):
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (at[1:] != at[:-1])
        values, at = values[keep], at[keep]
    return values, np.searchsorted(at, np.arange(len(counts) + 1))
