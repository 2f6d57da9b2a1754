"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest is kept, so two texts
that share a span of `window` words also share a kept fingerprint. Fingerprints
of documents and benchmark items are joined, and each hit is extended along its
diagonal to the maximal run of equal words; runs of at least `window` words are
contamination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bytetext import ALNUM, grams, slices, word_hashes
from ledgerloom.llm.scratch import batches_of, fresh, stored

#: Ids are worked on with an i before them, so that this key of items with a null id is none of them and sorts behind them.
UNNAMED = "n"
#: About as many items as a row of the shuffled path verifies at once.
ITEMS = 256
FOUND = "struct<n_words:bigint,n_hit:bigint,item_ids:array<string>,spans:array<struct<first:int,last:int>>>"


def _winnowed(words: np.ndarray, window: int, k: int) -> np.ndarray:
    """At each start of `window` words, the position of the smallest k-gram in it."""
    g = grams(words, k)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, window - k + 1):
        lower = g[j : j + n] < least
        least[lower] = g[j : j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    return at


class Index:
    """Fingerprints of benchmark items; an item of fewer words than a window counts whole."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, k: int):
        self.items, self.window, self.k = items, window, k
        prints, owner, place = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                self.short.setdefault(len(words), {}).setdefault(int(grams(words, len(words))[0]), []).append(i)
            at = np.unique(_winnowed(words, window, k))
            if len(at):
                prints.append(grams(words, k)[at])
                owner.append(np.full(len(at), i))
                place.append(at)
        flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((prints, np.uint64), (owner, np.int64), (place, np.int64))]
        order = np.argsort(flat[0], kind="stable")
        self.prints, self.owner, self.place = (x[order] for x in flat)
        self.short_keys = {m: np.array(sorted(x), np.uint64) for m, x in self.short.items()}

    def candidates(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k-gram positions that meet a kept fingerprint, rows with any hit candidate)."""
        g = grams(words, self.k)
        if not len(self.prints) or not len(g):
            at = np.zeros(0, np.int64)
        else:
            found = np.searchsorted(self.prints, g)
            found[found == len(self.prints)] = 0
            at = np.flatnonzero(self.prints[found] == g)
        hit = np.unique(np.searchsorted(rows, at, "right") - 1)
        for m, keys in self.short_keys.items():
            more = np.flatnonzero(np.isin(grams(words, m), keys))
            hit = np.union1d(hit, np.searchsorted(rows, more, "right") - 1)
        return at, hit

    def marked(self, words: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of one document are hit, and by windows of which items."""
        hit, items = np.zeros(len(words), bool), set()
        for i, diagonals in self._diagonals(words):
            if _extended(words, self.items[i][1], diagonals, self.window, hit):
                items.add(i)
        for m, keys in self.short.items():
            own = grams(words, m)
            for p in np.flatnonzero(np.isin(own, self.short_keys[m])):
                hit[p : p + m] = True
                items.update(keys[int(own[p])])
        return hit, items

    def _diagonals(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each item that shares fingerprints: at which distances, in words, these lie in the two texts."""
        kept = np.unique(_winnowed(words, self.window, self.k))
        g = grams(words, self.k)[kept] if len(kept) else np.zeros(0, np.uint64)
        low, high = np.searchsorted(self.prints, g, "left"), np.searchsorted(self.prints, g, "right")
        found: dict[int, list[np.ndarray]] = {}
        order = np.argsort(g, kind="stable")
        order = order[high[order] > low[order]]
        for same in np.split(order, np.flatnonzero(np.diff(low[order])) + 1) if len(order) else ():
            owner, place = self.owner[low[same[0]] : high[same[0]]], self.place[low[same[0]] : high[same[0]]]
            for i in np.unique(owner).tolist():
                found.setdefault(i, []).append(_distances(kept[same], place[owner == i]))
        for i, parts in found.items():
            yield i, np.unique(np.concatenate(parts))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct differences of two sets of positions; for many pairs from a correlation, in time that hangs on their reach."""
    if len(x) * len(y) <= 1 << 20:
        return np.unique(x[:, None] - y[None, :])
    n, m = int(x.max()) + 1, int(y.max()) + 1
    size = 1 << (n + m).bit_length()
    one, two = np.zeros(size), np.zeros(size)
    one[x], two[y] = 1, 1
    counts = np.fft.irfft(np.fft.rfft(one) * np.conj(np.fft.rfft(two)), size)
    at = np.flatnonzero(counts > 0.5)
    return np.sort(np.where(at < n, at, at - size))


def _extended(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray, window: int, hit: np.ndarray) -> bool:
    """Marks the words that lie in `window` equal words on one of the diagonals; whether there are any.

    Long overlaps come first, and diagonals on which all words are hit already are passed over.
    """
    n, m, found = len(words), len(item), False
    order = np.argsort(np.maximum(diagonals, 0) - np.minimum(diagonals + m, n), kind="stable")
    step = max(1, (1 << 20) // m)
    for at in range(0, len(order), step):
        own = diagonals[order[at : at + step]]
        if found:
            known = np.concatenate(([0], np.cumsum(hit)))
            a, b = np.maximum(own, 0), np.minimum(own + m, n)
            own = own[known[b] - known[a] < b - a]
        place = own[:, None] + np.arange(m)
        same = (place >= 0) & (place < n)
        same &= words[np.clip(place, 0, n - 1)] == item
        total = np.zeros((len(own), m + 1), np.int32)
        np.cumsum(same, axis=1, out=total[:, 1:])
        row, begin = np.nonzero(total[:, window:] - total[:, :-window] == window)
        if len(row):
            found = True
            turns = np.bincount(own[row] + begin, minlength=n + 1)[: n + 1] - np.bincount(own[row] + begin + window, minlength=n + 1)[: n + 1]
            hit |= np.cumsum(turns)[:n] > 0
    return found


def _found(rows: list[tuple[int, np.ndarray | None, list[str | None]]]) -> pa.Array:
    ids = [r[2] for r in rows]
    spans = []
    for _, hit, _ in rows:
        if hit is None or not hit.any():
            spans.append([])
            continue
        padded = np.concatenate(([False], hit, [False]))
        turns = np.flatnonzero(padded[1:] != padded[:-1])
        spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(turns[::2], turns[1::2], strict=True)])
    return pa.StructArray.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([0 if r[1] is None else int(r[1].sum()) for r in rows], pa.int64()),
            pa.array(ids, pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ],
        ["n_words", "n_hit", "item_ids", "spans"],
    )


def _items(names: pa.Array, texts: pa.Array) -> list[tuple[str, np.ndarray]]:
    out = []
    for low, high, data, offsets in slices(texts):
        words, rows = word_hashes(data, offsets, ALNUM)
        out += [(str(names[low + i]), words[rows[i] : rows[i + 1]]) for i in range(high - low)]
    return out


def _scan(index: Index):
    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows: list = []
            for low, high, data, offsets in slices(texts):
                words, at = word_hashes(data, offsets, ALNUM)
                _, maybe = index.candidates(words, at)
                maybe = set(maybe.tolist())
                for i in range(high - low):
                    n = int(at[i + 1] - at[i])
                    if i not in maybe:
                        rows.append((n, None, []))
                        continue
                    hit, items = index.marked(words[at[i] : at[i + 1]])
                    keys = sorted({index.items[j][0] for j in items})
                    rows.append((n, hit, [None if key == UNNAMED else key[1:] for key in keys]))
            yield _found(rows)

    return scan


def _prints(window: int, k: int, lengths: list[int], with_short: bool):
    """Kept fingerprints of each text; for texts that may hold short items, all runs of those lengths too."""

    @F.arrow_udf("struct<n_words:bigint,prints:array<bigint>>")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, kept = [], []
            for low, high, data, offsets in slices(texts):
                words, rows = word_hashes(data, offsets, ALNUM)
                for i in range(high - low):
                    own = words[rows[i] : rows[i + 1]]
                    parts = [grams(own, k)[np.unique(_winnowed(own, window, k))]]
                    parts += [grams(own, m) for m in lengths if with_short or m == len(own)]
                    counts.append(len(own))
                    kept.append(np.unique(np.concatenate(parts)).view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], ["n_words", "prints"])

    return prints


def _verify(window: int, k: int):
    """Which words of a text windows of the given items hit, and by which items."""

    @F.arrow_udf("struct<at:array<int>,item_ids:array<string>>")
    def verify(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, others in batches:
            at, ids = [], []
            for text, held in zip(texts, others.to_pylist(), strict=True):
                names, bodies = [x["item_id"] for x in held], [x["other"] for x in held]
                (_, words), *items = _items(["", *names], pa.array([text.as_py(), *bodies], pa.string()))
                hit, found = Index(items, window, k).marked(words)
                at.append(np.flatnonzero(hit).tolist())
                ids.append(sorted({items[i][0] for i in found}))
            yield pa.StructArray.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], ["at", "item_ids"])

    return verify


def _united():
    """What all items of a document hit, as one."""

    @F.arrow_udf(FOUND)
    def united(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for n_words, places, items in batches:
            rows: list = []
            for n, at, keys in zip(n_words.to_pylist(), places, items.to_pylist(), strict=True):
                if not keys:
                    rows.append((n, None, []))
                    continue
                hit = np.zeros(n, bool)
                hit[at.values.flatten().to_numpy()] = True
                rows.append((n, hit, [None if key == UNNAMED else key[1:] for key in keys]))
            yield _found(rows)

    return united


def contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = 5, most_words: int = 1_000_000, out: str = "contamination") -> DataFrame:
    """documents with a struct column: n_words, n_hit, item_ids (sorted as strings), spans of hit words.

    A benchmark whose texts have at most 2 * `most_words` bytes, and so no more
    than that many words, is broadcast as an index (under 40 bytes a word); a
    larger one is joined by fingerprint in a shuffle. Empty tables are fine. Null and
    empty texts have no words and no hits; items without words or with a null
    text never occur; an item of fewer words than a window is one window. Items
    with a null id count like others, but together are one null at the end of
    item_ids.
    Repeated rows are judged each on their own; items that repeat an item_id
    count once. Other columns pass through; if `out` is taken, underscores are
    added to it.
    """
    spark = documents.sparkSession
    out = fresh(documents.columns, out)
    items = benchmark.select(F.coalesce(F.concat(F.lit("i"), F.col("item_id").cast("string")), F.lit(UNNAMED)).alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= 2 * most_words:
        held = items.toArrow()
        index = Index(_items(held["item_id"].combine_chunks(), held["text"].combine_chunks()) if held.num_rows else [], window, k)
        return documents.withColumn(out, _scan(index)(F.col("text")))
    row = fresh([*documents.columns, out], "row")
    keyed = stored(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written, so that a row keeps its number
    # an item is known by a hash of its id and text, as many may share an id or have none; equal hashes only verify more
    bodies = items.dropDuplicates(["item_id", "text"]).withColumn("item", F.xxhash64("item_id", "text"))
    of_items = bodies.withColumn("p", _prints(window, k, list(range(1, window)), False)(F.col("text")))
    of_items = of_items.select("item", "p.n_words", F.explode("p.prints").alias("print"))
    lengths = [r[0] for r in of_items.where(F.col("n_words") < window).select("n_words").distinct().collect()]  # at most window - 1
    texts = keyed.select(row, "text")
    of_texts = stored(texts.select(row, _prints(window, k, lengths, True)(F.col("text")).alias("p")), "prints")
    pairs = of_texts.select(row, F.explode("p.prints").alias("print")).join(of_items.select("item", "print").distinct(), "print").select(row, "item").distinct()
    pairs = stored(pairs, "pairs")
    # ids meet first; the items of a row are gathered in slices, so a text moves once for about ITEMS of them and no slice grows with the benchmark
    slices_of = pairs.groupBy(row).agg(F.ceil(F.count("*") / ITEMS).alias("slices"))
    sliced = pairs.join(slices_of, row).withColumn("slice", F.pmod("item", "slices"))
    held = sliced.join(bodies.withColumnRenamed("text", "other"), "item").groupBy(row, "slice").agg(F.collect_list(F.struct("item_id", "other")).alias("held"))
    hits = held.join(texts, row).select(row, _verify(window, k)(F.col("text"), F.col("held")).alias("found")).select(row, "found.*").where(F.size("item_ids") > 0)
    gathered = hits.groupBy(row).agg(F.collect_list("at").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    counts = of_texts.select(row, F.col("p.n_words").alias("n_words"))
    joined = counts.join(gathered, row, "left").select(row, _united()(F.col("n_words"), F.col("at"), F.col("item_ids")).alias(out))
    return keyed.join(joined, row).drop(row)


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit word, with their own columns only; written to the shared folder."""
    flagged = contamination(documents, benchmark, **options)
    mark = flagged.columns[-1]
    with batches_of(documents.sparkSession, 1000):
        return stored(flagged.where(F.col(f"`{mark}`.n_hit") == 0).select(*[F.col(f"`{c}`") for c in documents.columns]), "clean")
