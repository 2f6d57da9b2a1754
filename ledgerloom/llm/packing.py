"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Only token counts matter to a packing, and there are at most `capacity` of
them. So Spark counts pieces by length, the driver packs that histogram (its
size does not depend on the data), and each piece finds its place from its rank
among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bytetext import SpanHash, slices
from ledgerloom.llm.scratch import batches_of, stored

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14), *range(28, 32)]] = True
_MAYBE_WHITE = _WHITE.copy()
_MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of the non-ASCII white space


class Encoder:
    """Token ids of texts, exactly those of the tokenizers file.

    The file's pre-tokenizer always starts a new piece at a blank that a
    non-white character follows, so what lies between two such blanks can be
    encoded alone. Each distinct chunk of a slice is encoded once, and all of
    them in one call: in a row they still keep their borders.
    """

    def __init__(self, path: str):
        self.fast = self._byte_pairs(path)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    def _byte_pairs(self, path: str):
        """The same byte-pair merges run by tiktoken if the file's vocabulary allows it, else None."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.sizes[i] = len(token)
        return tiktoken.Encoding("byte pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def one(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row of a slice."""
        if self.fast is None:
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                yield self.one(bytes(data[a:b]).decode())
            return
        starts = np.zeros(len(data) + 1, bool)
        starts[:-2] = (data[:-1] == 32) & ~_MAYBE_WHITE[data[1:]]
        starts[np.maximum(offsets[1:] - 1, 0)] = False
        apart = starts.copy()
        starts[offsets] = True
        begin = np.flatnonzero(starts[:-1])
        end = np.append(begin[1:], len(data))[: len(begin)]
        _, first, which = np.unique(SpanHash(data)(begin, end), return_index=True, return_inverse=True)
        flat, place, counts = self._chunks(data, begin[first], end[first], apart[begin[first]])
        counts = counts[which]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = flat[np.arange(total[-1]) + np.repeat(place[which] - total[:-1], counts)]
        row = total[np.searchsorted(begin, offsets)]
        for a, b in zip(row[:-1], row[1:], strict=True):
            yield ids[a:b]

    def _chunks(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, and where each chunk's begin and how many they are; those that start apart go in one call."""
        place, counts = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        size = (end - begin)[apart]
        last = np.cumsum(size)
        text = data[np.repeat(begin[apart] - last + size, size) + np.arange(size.sum())].tobytes().decode()
        parts = [self.one(text)]
        border = np.searchsorted(np.cumsum(self.sizes[parts[0]]), last, "right")
        counts[apart] = np.diff(border, prepend=0)
        place[apart] = border - counts[apart]
        at = len(parts[0])
        for i in np.flatnonzero(~apart):
            parts.append(self.one(data[begin[i] : end[i]].tobytes().decode()))
            place[i], counts[i] = at, len(parts[-1])
            at += counts[i]
        return np.concatenate(parts), place, counts


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One a worker: tasks that follow each other share it."""
    return Encoder(path)


def _cut(capacity: int, path: str, separator: int):
    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,part:int,rank:bigint>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, task = _encoder(path), TaskContext.get()
        seen = np.zeros(capacity + 1, np.int64)
        for texts in batches:
            counts, columns = [], [[] for _ in range(6)]
            for _, _, data, offsets in slices(texts, 1 << 19):
                for ids in encoder.rows(data, offsets):
                    ids = np.append(ids, np.uint32(separator)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    borders = [0, *range(first, len(ids) + 1, capacity)]
                    counts.append(len(borders) - 1)
                    for n, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
                        for column, value in zip(columns, (n, a, b - a, zlib.crc32(ids[a:b].tobytes()), task.partitionId(), int(seen[b - a])), strict=True):
                            column.append(value)
                        seen[b - a] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["piece", "start", "length", "ids_crc32", "part", "rank"]
            flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), flat)

    return cut


def best_two_fit(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Bins as (how many alike, lengths in them) for counts[n] pieces of length n.

    A bin opens with the longest piece left and is filled greedily with the
    longest that fit. Then its smallest piece is replaced by two unpacked ones
    if together they fit the gap that it leaves more tightly. The bin is used as
    often as the counts allow, so the number of different bins depends on the
    number of lengths, not on the number of pieces.
    """
    capacity, left, bins = len(counts) - 1, counts.astype(np.int64).copy(), []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return bins
        chosen, free, own = [], capacity, left.copy()
        while free and (fit := lengths[(lengths <= free) & (own[lengths] > 0)]).size:
            chosen.append(int(fit[-1]))
            own[fit[-1]] -= 1
            free -= int(fit[-1])
        if free and len(chosen) > 1:
            smallest = chosen[-1]
            gap = free + smallest
            have = lengths[(own[lengths] > 0) & (lengths < gap)]
            partner = have[np.maximum(np.searchsorted(have, gap - have, "right") - 1, 0)] if len(have) else have
            # a length with one piece left can't be its own partner: take the next smaller
            alone = (partner == have) & (own[have] < 2)
            if alone.any():
                before = np.searchsorted(have, partner[alone]) - 1
                partner[alone] = np.where(before >= 0, have[np.maximum(before, 0)], capacity)
            total = np.where(have + partner <= gap, have + partner, 0)
            if len(total) and total.max() > smallest:
                best = int(np.argmax(total))
                chosen[-1:] = sorted((int(have[best]), int(partner[best])), reverse=True)
        used = np.bincount(chosen, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        bins.append((times, chosen))


def _places(bins: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, first sequence, offset), by rank."""
    taken: dict[int, int] = {}
    places: dict[int, list] = {}
    sequence = 0
    for times, lengths in bins:
        offset = 0
        for length in lengths:
            at = taken.get(length, 0)
            places.setdefault(length, []).append((at, sequence, offset))
            taken[length] = at + times
            offset += length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in places.items()}


def _place(places: dict[int, np.ndarray]):
    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for one in np.unique(n):
            at, rows = n == one, places[int(one)]
            found = rows[np.searchsorted(rows[:, 0], r[at], "right") - 1]
            sequence[at], offset[at] = found[:, 1] + r[at] - found[:, 0], found[:, 2]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return place


def packed(documents: DataFrame, tokenizer: str, *, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the separator. One of more than `capacity`
    ids is cut: its first piece takes the rest, the others are full. A null text
    is empty and so one separator; repeated rows are packed each; a null doc_id
    stays null. `tokenizer` is a file that every executor has.

    Pieces are written once to the shared folder, since their ranks must not
    change when a lost task runs again.
    """
    pieces = documents.select("doc_id", F.explode(_cut(capacity, tokenizer, separator)(F.col("text"))).alias("p")).select("doc_id", "p.*")
    with batches_of(documents.sparkSession, 1000):
        pieces = stored(pieces, "pieces")
    dealt = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(_by_length()) - F.col("n")
    starts = stored(dealt.select("length", "part", "n", before.alias("before")), "ranks")  # at most `capacity` rows a task
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in starts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    places = _places(best_two_fit(counts))
    ranked = pieces.join(starts.select("length", "part", "before"), ["length", "part"])
    placed = ranked.withColumn("at", _place(places)(F.col("length"), F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def _by_length():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
