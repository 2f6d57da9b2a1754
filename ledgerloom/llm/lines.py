"""Line dedup with two Bloom filters: hashes seen once, and hashes seen twice.

Each task builds both filters over the lines of its documents, and they are
merged. A line whose hash is not in the merged second filter is unique. Only the
others are shuffled, by a 128-bit digest, to count the documents that hold them
and to find the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bloom
from ledgerloom.llm.bytetext import LOWER, NOT_SPACE, SpanHash, slices
from ledgerloom.llm.scratch import MOST_BROADCAST, batches_of, fresh, release, stored


def _lines(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the stripped keys of all lines that count, their rows and line numbers."""
    newline = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, newline, "right") - 1
    begin = np.sort(np.concatenate((offsets[:-1], newline + 1)), kind="stable")
    rows = np.concatenate((np.arange(len(offsets) - 1), row_of))
    rows = np.sort(rows, kind="stable")
    end = np.append(begin[1:], 0)
    last = np.append(rows[1:] != rows[:-1], True)
    end = np.where(last, offsets[rows + 1], end - 1)
    number = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    # strip: the first and last byte in each line that isn't white space
    solid = np.flatnonzero(NOT_SPACE[data])
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    full = b > a
    begin, end, rows, number, a, b = (x[full] for x in (begin, end, rows, number, a, b))
    begin, end = solid[a], solid[b - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[end] - points[begin] >= least
    return begin[long], end[long], rows[long], number[long]


def _filters(bits: int, least: int):
    """Compressed segments of a task's two filters."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = bloom.Pair(bits)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                low = LOWER[data]
                begin, end, rows, _ = _lines(low, offsets, least)
                at = bloom.places(SpanHash(low)(begin, end), bits)
                # once per document, then once and twice within the slice
                at, n = np.unique(np.unique(rows << bits | at) & (1 << bits) - 1, return_counts=True)
                pair.add(at, n > 1)
        yield pair.segments()

    return build


def twice_seen(documents: DataFrame, bits: int, least: int) -> bytes:
    """The merged second filter, 2 ** bits bits."""
    return bloom.merged(documents.select("text").mapInArrow(_filters(bits, least), bloom.SHAPE), bits, "twice")


def _most_lines(documents: DataFrame) -> int:
    """Lines of all texts."""
    of_text = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return documents.agg(F.coalesce(F.sum(of_text), F.lit(0))).first()[0]


def _suspects(held, bits: int, least: int):
    """Digests of the distinct lines of a text that the second filter holds."""

    @F.arrow_udf("array<binary>")
    def suspects(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        twice = np.frombuffer(held.value, np.uint8)
        for texts in batches:
            out: list[list[bytes]] = []
            for low_row, high_row, data, offsets in slices(texts):
                low = LOWER[data]
                begin, end, rows, _ = _lines(low, offsets, least)
                maybe = bloom.holds(twice, bloom.places(SpanHash(low)(begin, end), bits))
                own: list[set] = [set() for _ in range(high_row - low_row)]
                raw = low.tobytes()
                for a, b, r in zip(begin[maybe].tolist(), end[maybe].tolist(), rows[maybe].tolist(), strict=True):
                    own[r].add(hashlib.md5(raw[a:b], usedforsecurity=False).digest())
                out += [sorted(x) for x in own]
            yield pa.array(out, pa.list_(pa.binary()))

    return suspects


def _kept(least: int):
    @F.arrow_udf("struct<text:string,n_lines:bigint,n_dropped:bigint>")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, drops in batches:
            out, lines, gone = [], [], []
            for text, drop in zip(texts, drops, strict=True):
                text = text.as_py()
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if drop.as_py():
                    dropped = set(drop.as_py())
                    rest = [p for p in parts if _digest(p, least) not in dropped]
                    text = "\n".join(rest) if len(rest) < len(parts) else text
                    parts = rest
                out.append(text)
                gone.append(lines[-1] - len(parts))
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_lines", "n_dropped"])

    return kept


_SPACE = " \t\n\v\f\r"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _digest(line: str, least: int) -> bytes | None:
    key = line.strip(_SPACE)
    return hashlib.md5(key.translate(_ASCII_LOWER).encode(), usedforsecurity=False).digest() if len(key) >= least else None


def deduplicated(documents: DataFrame, *, least: int = 10, out: str = "line_dedup") -> DataFrame:
    """documents with a struct column of the new text, n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space, with A-Z lowered.
    Keys of at least `least` code points that at least two documents hold lose
    their lines, but in the document of the smallest doc_id all of them stay.
    Rows that share a doc_id are one document here; rows with a null doc_id take
    no part and keep all lines. A null or empty text is one empty line and stays
    as it is. An empty table gives an empty one.

    The filters have 8 bits a line of the input, at most 32 MB; beyond that more
    unique lines pass to the exact step, which drops nothing wrongly. Texts move
    only where it must be: if the keys to drop are few they are broadcast, else
    documents without any suspect line stay where they are.
    """
    return _deduplicated(documents, least, fresh(documents.columns, out))[0]


def _deduplicated(documents: DataFrame, least: int, out: str) -> tuple[DataFrame, DataFrame]:
    """The result, and the stored table that it reads besides documents."""
    spark = documents.sparkSession
    keys = fresh([*documents.columns, out], "drop")
    known = documents.where(F.col("doc_id").isNotNull())
    with batches_of(spark, 1000):
        bits = bloom.bits_for(_most_lines(known))
        held = spark.sparkContext.broadcast(twice_seen(known, bits, least))
        suspects = _suspects(held, bits, least)
        lines = stored(known.select("doc_id", F.explode(suspects(F.col("text"))).alias("key")), "suspects")
        # written, so that both sides of the join are dealt anew, and a line of very many documents can be split
        first = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
        first = stored(first, "repeated")
        drops = lines.join(first, "key").where(F.col("doc_id") > F.col("first")).groupBy("doc_id").agg(F.collect_set("key").alias(keys))
        drops = stored(drops, "drops")
    release(lines, first)
    rows, dropped = drops.agg(F.count("*"), F.coalesce(F.sum(F.size(keys)), F.lit(0))).first()
    if rows * 96 + dropped * 32 <= MOST_BROADCAST:
        joined = documents.join(F.broadcast(drops), "doc_id", "left")
    else:
        mark = fresh([*documents.columns, out, keys], "suspect")
        marked = documents.withColumn(mark, F.col("doc_id").isNotNull() & (F.size(suspects(F.col("text"))) > 0))
        still = marked.where(~F.col(mark)).withColumn(keys, F.lit(None).cast("array<binary>"))
        joined = marked.where(F.col(mark)).join(drops, "doc_id", "left").unionByName(still)
    own = [F.col(f"`{c}`") for c in documents.columns]
    return joined.select(*own, _kept(least)(F.col("text"), F.col(f"`{keys}`")).alias(out)), drops


def without_repeats(documents: DataFrame, *, least: int = 10) -> DataFrame:
    """documents, same columns, with the repeated lines gone from text; written to the shared folder."""
    struct = fresh(documents.columns, "line_dedup")
    done, drops = _deduplicated(documents, least, struct)
    own = [F.col(f"`{struct}`.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns]
    with batches_of(documents.sparkSession, 1000):
        kept = stored(done.select(*own), "deduplicated")
    release(drops)
    return kept
