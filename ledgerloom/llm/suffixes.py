"""Removal of long repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

Every string of `length` bytes (a window) belongs to the smallest hash among its
k-grams, its anchor, so equal windows share an anchor. Neighbouring windows of
one anchor make a piece of text. Pieces meet by anchor: equal ones are counted,
and the different ones of an anchor go, with those of other anchors, into a block
of bounded size, whose suffixes are sorted and transformed. There, breadth-first
backward extension from the empty string finds the intervals of all strings of
1, 2, 3, ... bytes, and with them where neighbouring suffixes have a common prefix
of 0, 1, 2, ... bytes. It stops at `length`: suffixes whose common prefix has not
been found by then share at least as much.

Anchors that a Bloom filter shows only once are left alone from the start.
An anchor with too many different pieces for a block is split: its windows are
dealt again by longer and longer grams, the last of them the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bloom
from ledgerloom.llm.bytetext import SpanHash, give_back, mix, slices
from ledgerloom.llm.scratch import MOST_BROADCAST, batches_of, fresh, release, small, stored

BLOCK = 1 << 20  # bytes of different pieces of an anchor, and of anchors whose pieces share a block
CHUNK = 1 << 21  # bytes of a text that are hashed at a time
OFTEN = 256  # copies of a piece from which its spans are joined apart from the others
FOUND = "k1 bigint, k2 bigint, h bigint, digest binary, size int, at array<int>"


# -- anchors -----------------------------------------------------------------


def smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbouring grams, from minima to both sides within blocks of that width."""
    n = len(grams)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = grams
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def runs(data: np.ndarray, allowed: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of neighbouring allowed windows that share an anchor, and the anchor's hash.

    Of equal grams in a window the first is its anchor, so a run ends where it starts with its anchor.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length or not allowed.any():
        return none, none, none
    begin = np.arange(len(data) - k + 1)
    grams = SpanHash(data)(begin, begin + k)
    anchor = smallest(grams, length - k + 1)
    starts = np.flatnonzero(allowed)
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1) | (grams[starts[:-1]] == own[:-1])
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1], own[first].view(np.int64)


def _allowed(offsets: np.ndarray, windows: list | None, length: int) -> np.ndarray:
    """Which bytes start a window that is whole in its row, and listed where windows are given."""
    change = np.zeros(offsets[-1] + 2, np.int64)
    if windows is None:
        full = np.flatnonzero(np.diff(offsets) >= length)
        np.add.at(change, offsets[full], 1)
        np.add.at(change, offsets[full + 1] - length + 1, -1)
    else:
        for low, own in zip(offsets, windows, strict=False):
            spans = np.asarray(own, np.int64).reshape(-1, 2) + low
            np.add.at(change, spans[:, 0], 1)
            np.add.at(change, spans[:, 1], -1)
    return np.cumsum(change)[: max(offsets[-1] - length + 1, 0)] > 0


def _found(batch: pa.RecordBatch, k: int, length: int) -> Iterator[tuple]:
    """First row, offsets, place of a part, its bytes, and its runs, for each part of a batch of (k1, k2, text) or (k1, k2, text, windows)."""
    given = batch.column(3).to_pylist() if batch.num_columns > 3 else None
    for low, high, data, offsets in slices(batch.column(2)):
        allowed = _allowed(offsets, given and given[low:high], length)
        for base in range(0, max(len(allowed), 1), CHUNK):
            part = data[base : base + CHUNK + length - 1]
            yield low, high, offsets, base, part, *runs(part, allowed[base : base + CHUNK], k, length)


def _filters(bits: int, k: int, length: int):
    """Compressed segments of a task's filters of anchors seen once and twice. Anchors are small hashes, so they are mixed again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = bloom.Pair(bits)
        for batch in batches:
            for *_, hashes in _found(batch, k, length):
                at, n = np.unique(bloom.places(mix(hashes.view(np.uint64)), bits), return_counts=True)
                pair.add(at, n > 1)
        yield pair.segments()

    return build


def _pieces(k: int, length: int, held, bits: int):
    """The pieces of a task's texts: a row per text and different piece, with the places where it begins. Anchors that the filter of those seen twice doesn't hold are left out."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(held.value, np.uint8) if held is not None else None
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            for low, _, offsets, base, part, first, last, hashes in _found(batch, k, length):
                if twice is not None:
                    maybe = bloom.holds(twice, bloom.places(mix(hashes.view(np.uint64)), bits))
                    first, last, hashes = first[maybe], last[maybe], hashes[maybe]
                row = np.searchsorted(offsets, first + base, "right") - 1
                place, raw = first + base - offsets[row], part.tobytes() if len(first) else b""
                for r, h, a, b, p in zip(row.tolist(), hashes.tolist(), first.tolist(), (last + length).tolist(), place.tolist(), strict=True):
                    found.setdefault((low + r, h, hashlib.md5(raw[a:b], usedforsecurity=False).digest(), b - a), []).append(p)
            rows = pa.array([x[0] for x in found], pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())]
            columns += [pa.array([x[3] for x in found], pa.int32()), pa.array(list(found.values()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "h", "digest", "size", "at"])

    return pieces


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted pieces of each text."""
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            rows = wanted.as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["h"] for w in rows], pa.int64()), pa.array([w["digest"] for w in rows], pa.binary()), pa.array([w["n"] for w in rows], pa.int64()), pa.array([raw[w["at"] : w["at"] + w["size"]] for w in rows], pa.binary())],
                ["h", "digest", "n", "piece"],
            )


# -- interval expansion --------------------------------------------------------


def suffix_order(symbols: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first `depth` symbols of so many bits, by doubling of the sorted length."""
    n, known = len(symbols), 63 // bits
    key = np.zeros(n, np.uint64)
    for j in range(known):
        key <<= np.uint64(bits)
        key[: max(n - j, 0)] |= symbols[j:].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    held = key[order]
    head = np.ones(n, bool)
    head[1:] = held[1:] != held[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while known < depth:
        # rows that share their rank with a neighbour
        open_ = ~head
        open_[:-1] |= ~head[1:]
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        at = order[rows]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + known, n)] + 1
        turn = np.argsort(pair, kind="stable")
        at, pair = at[turn], pair[turn]
        order[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = pair[1:] != pair[:-1]
        head[rows] = new
        rank[at] = np.maximum.accumulate(np.where(new, rows, 0))
        known *= 2
    return order


class Transform:
    """A Burrows-Wheeler transform that extends many intervals to the left at once; symbol 0 is a separator."""

    def __init__(self, symbols: np.ndarray, bits: int, order: np.ndarray):
        self.last = symbols[order - 1]
        counts = np.bincount(self.last, minlength=1 << bits)
        self.less = np.concatenate(([0], np.cumsum(counts)[:-1]))
        by_symbol = np.argsort(self.last, kind="stable")
        self.step = np.empty(len(order), np.int64)  # where the suffix that is one longer stands
        self.step[by_symbol] = np.arange(len(order))
        # a wavelet matrix: for each bit, how many zeros come before a place
        self.zeros, now = [], self.last
        for b in range(bits - 1, -1, -1):
            one = (now >> b) & 1 > 0
            self.zeros.append(np.concatenate(([0], np.cumsum(~one, dtype=np.int32))).astype(np.int32))
            now = np.concatenate((now[~one], now[one]))
        self.base = np.zeros(1 << bits, np.int64)
        starts = np.flatnonzero(np.append(True, now[1:] != now[:-1]))
        self.base[now[starts]] = starts

    def extended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols before the suffixes of each interval, and the intervals of the strings with them in front."""
        one = high - low == 1
        single = low[one]
        low, high = low[~one], high[~one]
        symbol = np.zeros(len(low), np.int64)
        for zeros in self.zeros if len(low) else ():
            a, b, total = zeros[low], zeros[high], int(zeros[-1])
            left, right = b > a, (high - low) > (b - a)
            symbol = np.concatenate((symbol[left] << 1, symbol[right] << 1 | 1))
            low, high = np.concatenate((a[left], total + (low - a)[right])), np.concatenate((b[left], total + (high - b)[right]))
        move = self.less[symbol] - self.base[symbol]
        to = self.step[single]
        return np.concatenate((symbol, self.last[single])), np.concatenate((low + move, to)), np.concatenate((high + move, to + 1))


def repeated(data: np.ndarray, separators: np.ndarray, length: int) -> np.ndarray:
    """Which places begin a string of `length` bytes, free of separators, that begins elsewhere too.

    Where a string would hold a separator the answer has no meaning.
    """
    held = np.bincount(data[~separators], minlength=256) > 0
    code = np.where(held, np.cumsum(held), 0)
    symbols = np.where(separators, 0, code[data])
    bits = max(1, int(held.sum()).bit_length())
    n = len(symbols)
    order = suffix_order(symbols, bits, length)
    transform = Transform(symbols, bits, order)
    known = np.zeros(n + 1, bool)  # whether the common prefix of the suffixes on both sides has been found
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for shared in range(length):
        symbol, low, high = transform.extended(low, high)
        new = ~known[high] & ((symbol > 0) | (shared == 0))
        low, high = low[new], high[new]
        if not len(low):
            break
        known[high] = True  # they share `shared` bytes
    out = np.zeros(n, bool)
    out[order] = ~(known[:-1] & known[1:])
    return out


def _spans(inside: np.ndarray) -> list[int]:
    """Begins and ends of the runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0])))).tolist()


def _expanded(length: int, block: int):
    """Spans of repeated windows in each piece that occurs once; a task goes through its anchors block by block."""

    def solve(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"\0".join(p for *_, p in rows) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for *_, p in rows]) - 1
        separators = np.zeros(len(data), bool)
        separators[ends] = True
        again = repeated(data, separators, length)
        out = []
        for (h, digest, n, piece), end in zip(rows, ends.tolist(), strict=True):
            spans = _spans(again[end - len(piece) : end - length + 1]) if n == 1 else []
            if spans:
                out.append((h, digest, spans))
        give_back()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["h", "digest", "spans"])

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for h, digest, n, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if h != last and held >= block:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append((h, digest, n, piece))
                held, last = held + len(piece), h
        if rows:
            yield solve(rows)

    return expanded


# -- the whole -------------------------------------------------------------------


def _ladder(length: int) -> list[int]:
    """Lengths of grams: the first anchors, and those that split anchors of too many pieces; the last are whole windows."""
    return sorted({max(1, length * 3 // 10), max(1, length * 4 // 5), max(1, length - length // 25), length})


def _join(left: DataFrame, right: DataFrame, on: list[str], rows_bytes: int) -> DataFrame:
    """right, a stored table, joined by broadcast if it takes few bytes."""
    return left.join(F.broadcast(right) if rows_bytes <= MOST_BROADCAST // 4 else right, on)


def _level(keyed: DataFrame, k: int, length: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Spans of repeated windows by text (at, spans), and the windows that longer grams have to split, if any."""
    key, spark = ["h", "digest"], keyed.sparkSession
    held, bits = None, 0
    if "windows" not in keyed.columns:
        # about two anchors for as many bytes as a gram can move in a window
        total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = bloom.bits_for(2 * total // (length - k + 2))
        held = spark.sparkContext.broadcast(bloom.merged(keyed.mapInArrow(_filters(bits, k, length), bloom.SHAPE), bits, "twice"))
    found = stored(keyed.mapInArrow(_pieces(k, length, held, bits), FOUND), "pieces")
    pieces = found.groupBy(*key).agg(F.sum(F.size("at")).alias("n"), F.min(F.struct("k1", "k2", F.col("at")[0].alias("at"))).alias("of"), F.max("size").alias("size"))
    pieces = stored(pieces, "different")
    groups = stored(pieces.groupBy("h").agg(F.count("*").alias("different"), F.sum("size").alias("bytes")).where("different > 1"), "anchors")
    hot = stored(groups.where(F.col("bytes") > block).select("h"), "hot")
    some = hot.count() > 0
    rest = pieces.join(small(hot), "h", "left_anti") if some else pieces
    compared = rest.join(groups.where(F.col("bytes") <= block).select("h"), "h", "left_semi")
    # texts of the first place of each piece
    wanted = compared.groupBy("of.k1", "of.k2").agg(F.collect_list(F.struct("h", "digest", "n", "of.at", "size")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    rows, parts = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    texts = keyed.select("k1", "k2", "text")
    if rows * 64 + parts * 56 > MOST_BROADCAST // 4 and rows * 32 <= MOST_BROADCAST:
        texts = texts.join(F.broadcast(wanted.select("k1", "k2")), ["k1", "k2"], "left_semi")  # only texts that give pieces move
    texts = _join(texts, wanted, ["k1", "k2"], rows * 64 + parts * 56).select("text", "wanted")
    dealt = texts.mapInArrow(_cut, "h bigint, digest binary, n bigint, piece binary").repartition("h").sortWithinPartitions("h")
    own = dealt.mapInArrow(_expanded(length, block), "h bigint, digest binary, spans array<int>").withColumn("n", F.lit(1).cast("bigint"))
    whole = pieces.where("n > 1").select("h", "digest", F.array(F.lit(0), F.col("size") - length + 1).alias("spans"), "n")
    marks = stored(own.unionByName(whole), "marks")
    release(wanted)
    often = stored(marks.where(F.col("n") > OFTEN).drop("n"), "often")
    seldom, left = marks.where(F.col("n") <= OFTEN).drop("n"), found.select("k1", "k2", *key, "at")
    if often.count():
        apart = small(often, 96)
        spans = left.join(apart, key).unionByName(left.join(apart.select(key), key, "left_anti").join(seldom, key))
    else:
        spans = left.join(seldom, key)
    spans = stored(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "spans")).alias("marks")), "spans")
    again = None
    if some:
        again = pieces.join(small(hot), "h", "left_semi").groupBy("of.k1", "of.k2").agg(F.flatten(F.collect_list(F.array(F.col("of.at"), F.col("of.at") + F.col("size") - length + 1))).alias("windows"))
        again = stored(again, "windows")
    release(found, pieces, groups, hot, marks, often)
    return spans, again


def _runs(length: int):
    @F.arrow_udf("array<int>")
    def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out = []
            for marks in lists.to_pylist():
                spans = sorted((a + s, a + e - 1 + length) for m in marks for a in m["at"] for s, e in zip(m["spans"][::2], m["spans"][1::2], strict=True))
                held: list[int] = []
                for begin, end in spans:
                    if held and begin <= held[-1]:
                        held[-1] = max(held[-1], end)
                    else:
                        held += [begin, end]
                out.append(held)
            yield pa.array(out, pa.list_(pa.int32()))

    return merged


def _removed():
    @F.arrow_udf("struct<kept:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint>")
    def removed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            kept, sizes, gone, spans = [], [], [], []
            for text, own in zip(texts, lists, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                cuts = own.as_py() or []
                rest = b"".join(raw[a:b] for a, b in zip([0, *cuts[1::2]], [*cuts[::2], len(raw)], strict=True))
                kept.append(rest)
                sizes.append(len(raw))
                gone.append(len(raw) - len(rest))
                spans.append(len(cuts) // 2)
            yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())], ["kept", "n_bytes", "n_removed", "n_spans"])

    return removed


def without_repeats(documents: DataFrame, *, length: int = 400, block: int = BLOCK, out: str = "suffix_dedup") -> DataFrame:
    """documents with a struct column: kept (bytes), n_bytes, n_removed, n_spans.

    Removed is every byte that lies in a string of `length` bytes of the text's
    UTF-8 form that begins in some other place too, of the same text or another;
    strings never cross texts, and all are judged on the input. `kept` are the
    bytes left, one after the other (cuts may fall inside a character), and
    `n_spans` counts maximal removed runs.

    A null text is empty; texts shorter than `length` stay as they are. Rows are
    documents each: equal rows, or rows that repeat or lack a doc_id, repeat each
    other's texts. Texts may be of any length. An empty table gives an empty one,
    and columns whose names clash with those used here do no harm.

    Rows are known by two 64-bit hashes of id and text, and equal pieces by 128-bit
    digests. The filter has 8 bits an anchor, at most 32 MB; beyond that more
    anchors pass to the counting, and none gets lost. `block` bounds the bytes of different pieces that are sorted together
    (twice as many at most); anchors with more are dealt again by longer grams.
    """
    spark, name = documents.sparkSession, fresh(documents.columns, out)
    own = [F.col(f"`{c}`") for c in documents.columns]
    k1, k2, cuts = (fresh([*documents.columns, name], c) for c in ("k1", "k2", "cuts"))
    keys = [F.xxhash64(F.lit(i), F.col("doc_id").isNull(), "doc_id", "text") for i in (1, 2)]
    keyed = documents.where(F.octet_length("text") >= length).select(keys[0].alias("k1"), keys[1].alias("k2"), "text")
    with batches_of(spark, 500):
        levels, windows = [], None
        for k in _ladder(length):
            texts = keyed
            if windows is not None:
                rows, parts = windows.agg(F.count("*"), F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()
                texts = _join(keyed, windows, ["k1", "k2"], rows * 64 + parts * 4)
            spans, more = _level(texts, k, length, block)
            release(windows)
            levels, windows = [*levels, spans], more
            if windows is None:
                break
        marks = levels[0]
        for spans in levels[1:]:
            marks = marks.unionByName(spans)
        merged = marks.groupBy("k1", "k2").agg(F.flatten(F.collect_list("marks")).alias("marks"))
        merged = stored(merged.select(F.col("k1").alias(k1), F.col("k2").alias(k2), _runs(length)(F.col("marks")).alias(cuts)), "cuts")
    release(*levels)
    rows, parts = merged.agg(F.count("*"), F.coalesce(F.sum(F.size(cuts)), F.lit(0))).first()
    few = rows * 64 + parts * 4 <= MOST_BROADCAST // 2
    joined = documents.withColumn(k1, keys[0]).withColumn(k2, keys[1]).join(F.broadcast(merged) if few else merged, [k1, k2], "left")
    return joined.select(*own, _removed()(F.col("text"), F.col(f"`{cuts}`")).alias(name))
