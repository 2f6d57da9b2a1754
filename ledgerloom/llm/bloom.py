"""Bloom filters built by tasks in compressed segments, merged in streams, and sized by what they hold.

A key is a 64-bit hash; its highest bits are its place. A task builds `once`, the
places of its keys, and `twice`, the places that two of its rows share. Filters of
two tasks merge as (a | b, twice a | twice b | once a & once b). Segments of a
group are merged one after the other, so a task holds two segments whatever the
number of tasks before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = 64
SHAPE = "segment int, once binary, twice binary"
_NAMES = ["segment", "once", "twice"]
LEAST_BITS, MOST_BITS = 16, 28  # at most 32 MB; what is beyond that lets more keys pass, and none get lost


def bits_for(keys: int, each: int = 8) -> int:
    """The power of two of a filter's size for so many keys: `each` bits a key."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, keys) * each - 1).bit_length()))


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def holds(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places are set."""
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Pair:
    """A task's two filters."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)

    def add(self, at: np.ndarray, repeated: np.ndarray) -> None:
        """Distinct places, and which of them two rows share."""
        self._set(self.twice, at[repeated | holds(self.once, at)])
        self._set(self.once, at)

    @staticmethod
    def _set(held: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def segments(self) -> pa.RecordBatch:
        """The segments that are not empty."""
        pack, step = zstandard.ZstdCompressor(level=1), len(self.once) // SEGMENTS
        parts = [(i, self.once[i * step : (i + 1) * step], self.twice[i * step : (i + 1) * step]) for i in range(SEGMENTS)]
        parts = [p for p in parts if p[1].any()]
        packed = [pa.array([pack.compress(p[i].tobytes()) for p in parts], pa.binary()) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), *packed], _NAMES)


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = twice = None
    for batch in batches:
        for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
            own, more = (np.frombuffer(zstandard.decompress(x.as_buffer()), np.uint8) for x in (a, b))
            if once is None:
                once, twice = own.copy(), more.copy()
            else:
                twice |= more | once & own
                once |= own
    packed = [pa.array([zstandard.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice)]
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *packed], _NAMES)


def merged(parts: DataFrame, bits: int, which: str) -> bytes:
    """The filter `once` or `twice` of all tasks' segments; its bounded size is what the driver gets."""
    salted = parts.withColumn("salt", F.spark_partition_id() % 64)  # many tasks: merged in two steps
    done = salted.groupBy("segment", "salt").applyInArrow(_merge, SHAPE).groupBy("segment").applyInArrow(_merge, SHAPE)
    step = (1 << (bits - 3)) // SEGMENTS
    found = bytearray(step * SEGMENTS)
    for segment, packed in done.select("segment", which).collect():
        found[segment * step : (segment + 1) * step] = zstandard.decompress(packed)
    return bytes(found)
