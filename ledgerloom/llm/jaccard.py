"""Exact Jaccard join of word n-gram sets, for the components that its links form.

Sets of similar size meet in tiles. A tile is a band of set sizes and a shingle
that its members hold among their rarest: two sets that are similar enough must
share one. Every set has a hashed bitmap; as each bit in which two bitmaps differ
is owed to a shingle that only one set has, the count of such bits bounds the
overlap from above, and only pairs within the bound are intersected as sorted
arrays.

Only components are asked for, so a pair within one component need not be
compared. First come rounds in which every tile has a leader drawn by hash, and
every set is compared with that leader of its tiles whose bitmap is nearest; they
already join up most of a group of near copies. Then the tiles compare the pairs
whose components still differ. No pair of different components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bloom
from ledgerloom.llm.bytetext import NOT_SPACE, by_row, distinct_shingles, mix, slices, word_hashes
from ledgerloom.llm.graph import components, joined_up
from ledgerloom.llm.scratch import batches_of, fresh, release, small, stored

COUNT_BITS, SEGMENTS = 20, 64
ROUNDS = 2
LEAST_BITS, MOST_BITS = 64, 1 << 16
HOT, SIDE = 1 << 12, 1024  # comparisons from which a tile is dealt in blocks, and rows of a block's side
TILE_WORDS = 32  # of 64 bits: a tile's rows carry no longer bitmaps; the whole ones follow for the pairs that pass


def _entity(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A hash of each whole set; equal sets have equal ones."""
    mixed = mix(values + np.uint64(0x1234567))
    first = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    second = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    total = mix(first[borders[1:]] - first[borders[:-1]]) ^ (second[borders[1:]] - second[borders[:-1]]) * np.uint64(3)
    return mix(total + np.diff(borders).astype(np.uint64)).view(np.int64)


def _sets(k: int):
    """Rows of (doc_id, n, entity), and at a task's end its counts of shingles by hash bucket."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "entity", "segment", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            sizes, entities = [], []
            for _, _, data, offsets in slices(batch.column(1)):
                values, borders = distinct_shingles(*word_hashes(data, offsets, NOT_SPACE), k)
                counts += np.bincount((values >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))
                sizes.append(np.diff(borders))
                entities.append(_entity(values, borders))
            if sizes:
                nothing = [pa.nulls(len(batch), kind) for kind in kinds[3:]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(entities), pa.int64()), *nothing], names)
        step = len(counts) // SEGMENTS
        full = [i for i in range(SEGMENTS) if counts[i * step : (i + 1) * step].any()]
        packed = [zstandard.compress(counts[i * step : (i + 1) * step].tobytes(), 1) for i in full]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(full), kind) for kind in kinds[:3]), pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names)

    return sets


def _entities(k: int):
    """The size of a text's set and its hash."""

    @F.arrow_udf("struct<n:bigint,entity:bigint>")
    def entities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n, entity = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in slices(texts):
                values, borders = distinct_shingles(*word_hashes(data, offsets, NOT_SPACE), k)
                n.append(np.diff(borders))
                entity.append(_entity(values, borders))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (n, entity)], ["n", "entity"])

    return entities


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << COUNT_BITS) // SEGMENTS, np.int64)
    for batch in batches:
        for packed in batch.column("counts"):
            total += np.frombuffer(zstandard.decompress(packed.as_buffer()), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], ["segment", "counts"])


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """Shingles of all documents by hash bucket; the table has a fixed size."""
    parts = rows.where("segment is not null").select("segment", "counts", (F.spark_partition_id() % 64).alias("salt"))
    shape = "segment int, counts binary"
    done = parts.groupBy("segment", "salt").applyInArrow(_summed, shape).groupBy("segment").applyInArrow(_summed, shape).collect()
    step = (1 << COUNT_BITS) // SEGMENTS
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for segment, packed in done:
        total[segment * step : (segment + 1) * step] = np.frombuffer(zstandard.decompress(packed), np.int64)
    return total


def band_of(n: int, percent: int) -> int:
    """Sets of which the smaller has `percent` of the larger's size are in one band or in neighbours."""
    return math.floor(math.log(n) / math.log(100 / percent) + 1e-9)


def bitmap_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (2 * n - 1).bit_length()))


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit i: whether an odd number of the values end in i. Halves XORed give the bitmap of half the size."""
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: larger counts never get smaller numbers, and only 0 and 1 stay below TWICE."""
    return np.minimum(np.log2(counts + 1.0) * 1024, 65_535).astype(np.uint16)


TWICE = int(_rarity(np.array([2]))[0])


def _prefixes(k: int, percent: int, held):
    """The rarest shingles of each set, and the set's bitmap.

    Two similar sets share one of these; it is also among the first `few` of the
    smaller set, or of either if they have the same size.
    """

    @F.arrow_udf("struct<entity:bigint,n:bigint,band:int,few:int,tokens:array<bigint>,bits:array<bigint>>")
    def prefixes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rarity = held.value
        for texts in batches:
            entity, size, band, few, tokens, bits = [], [], [], [], [], []
            for _, _, data, offsets in slices(texts):
                values, borders = distinct_shingles(*word_hashes(data, offsets, NOT_SPACE), k)
                often = rarity[(values >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                row = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
                order = by_row(row, np.argsort(often, kind="stable"))
                ordered, alone = values[order], often[order] < TWICE
                entity.append(_entity(values, borders))
                for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    n = b - a
                    size.append(n)
                    if not n:
                        band.append(None)
                        few.append(0)
                        tokens.append([])
                        bits.append([])
                        continue
                    length = n - -(-percent * n // 100) + 1
                    band.append(band_of(n, percent))
                    shared = ~alone[a : a + length]
                    few.append(int(shared[: n - -(-2 * percent * n // (100 + percent)) + 1].sum()))
                    tokens.append(ordered[a : a + length][shared].view(np.int64))
                    bits.append(bitmap(values[a:b], bitmap_bits(n)))
            lists = pa.list_(pa.int64())
            columns = [pa.array(np.concatenate(entity) if entity else [], pa.int64()), pa.array(size, pa.int64()), pa.array(band, pa.int32()), pa.array(few, pa.int32()), pa.array(tokens, lists), pa.array(bits, lists)]
            yield pa.StructArray.from_arrays(columns, ["entity", "n", "band", "few", "tokens", "bits"])

    return prefixes


def _token_filter(bits: int):
    """A filter of a task's tokens."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = bloom.Pair(bits)
        for batch in batches:
            at = np.unique(bloom.places(mix(batch.column(0).to_numpy().view(np.uint64)), bits))
            pair.add(at, np.zeros(len(at), bool))
        yield pair.segments()

    return build


def _held_tokens(held, bits: int):
    """(token, whether it is among the set's first few) of those tokens that the filter holds."""

    @F.arrow_udf("array<struct<token:bigint,first:boolean>>")
    def tokens(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = np.frombuffer(held.value, np.uint8)
        for lists, few in batches:
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), length)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            keep = bloom.holds(known, bloom.places(mix(flat.view(np.uint64)), bits))
            first = at < few.to_numpy(zero_copy_only=False)[row]
            borders = np.searchsorted(row[keep], np.arange(len(length) + 1))
            pairs = pa.StructArray.from_arrays([pa.array(flat[keep], pa.int64()), pa.array(first[keep], pa.bool_())], ["token", "first"])
            yield pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pairs)

    return tokens


def _shingles(k: int):
    """The sorted shingles of a text whose set is the one asked for, else null."""

    @F.arrow_udf("binary")
    def shingles(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, asked in batches:
            out: list[bytes | None] = []
            for low, _, data, offsets in slices(texts):
                values, borders = distinct_shingles(*word_hashes(data, offsets, NOT_SPACE), k)
                for i, own in enumerate(_entity(values, borders).tolist()):
                    out.append(values[borders[i] : borders[i + 1]].tobytes() if own == asked[low + i].as_py() else None)
            yield pa.array(out, pa.binary())

    return shingles


def _linked(percent: int):
    """Whether two sets link, by intersecting their sorted arrays."""

    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out: list[bool] = []
            for one, two in zip(left, right, strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                out.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.array(out, pa.bool_())

    return linked


_DIFFERING = "aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
#: A bitmap folded to the length of the shorter one.
_FOLDED = "if(size({x}) > {n}, zip_with(slice({x}, 1, {n}), slice({x}, {n} + 1, {n}), (p, q) -> p ^ q), {x})"


#: A bitmap folded to half its size.
_HALF = "zip_with(slice({a}, 1, cast(size({a}) / 2 as int)), slice({a}, cast(size({a}) / 2 as int) + 1, cast(size({a}) / 2 as int)), (p, q) -> p ^ q)"


def _shortened(bits: str, most: int) -> str:
    """A bitmap folded until it has at most `most` words."""
    folds = (MOST_BITS // 64 // most).bit_length() - 1
    return f"aggregate(sequence(1, {folds}), {bits}, (a, i) -> if(size(a) > {most}, {_HALF.format(a='a')}, a))"


def _differing(x: str, y: str) -> str:
    """In how many bits the bitmaps of two sets of one tile differ."""
    shorter = f"least(size({x}.bits), size({y}.bits))"
    return _DIFFERING.format(x=_FOLDED.format(x=f"{x}.bits", n=shorter), y=_FOLDED.format(x=f"{y}.bits", n=shorter))


def _near(x: str, y: str, percent: int) -> str:
    """Whether sizes and bitmaps of two sets of one tile allow a link."""
    sizes = f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
    return f"{sizes} and {100 + percent} * {_differing(x, y)} <= {100 - percent} * ({x}.n + {y}.n)"


def _block_pairs(percent: int):
    """The pairs of a block's two sides that `_tile_pairs` asks for."""

    def sides(table: pa.Table, side: int) -> tuple[dict[str, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
        own = table.filter(pc.equal(table["side"], side)).combine_chunks()
        columns = {c: own[c].to_numpy() for c in ("entity", "component", "n", "band", "first")}
        words = pc.list_value_length(own["bits"]).to_numpy()
        flat = pc.list_flatten(own["bits"]).to_numpy().view(np.uint64)
        begin = np.cumsum(words) - words
        by_size = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
        return columns, {w: (rows, flat[begin[rows][:, None] + np.arange(w)]) for w, rows in by_size.items()}

    def folded(bits: np.ndarray, words: int) -> np.ndarray:
        while bits.shape[1] > words:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        return bits

    def block_pairs(table: pa.Table) -> pa.Table:
        (x, x_bits), (y, y_bits) = sides(table, 0), sides(table, 1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, ours in x_bits.values():
            for other, theirs in y_bits.values():
                words = min(ours.shape[1], theirs.shape[1])
                right = folded(theirs, words)
                for low in range(0, len(own), 256):
                    rows, left = own[low : low + 256], folded(ours[low : low + 256], words)
                    differing = np.zeros((len(rows), len(other)), np.int64)
                    for w in range(words):
                        differing += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
                    n, m = x["n"][rows][:, None], y["n"][other][None, :]
                    near = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * differing <= (100 - percent) * (n + m))
                    near &= x["component"][rows][:, None] != y["component"][other][None, :]
                    near &= (x["band"][rows][:, None] < y["band"][other][None, :]) | (x["entity"][rows][:, None] < y["entity"][other][None, :])
                    near &= np.where(n <= m, x["first"][rows][:, None], y["first"][other][None, :])
                    i, j = np.nonzero(near)
                    a.append(x["entity"][rows[i]])
                    b.append(y["entity"][other[j]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return block_pairs


def _tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of one tile whose components differ and whose sizes and bitmaps allow a link; a pair may come from several tiles.

    Tiles of few comparisons are joined. The others are cut: each side is dealt
    into blocks, and every block of one meets every block of the other, as arrays.
    """
    lower = tiles.withColumn("tile", F.col("band"))
    upper = tiles.withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    sized = upper.groupBy("token", "tile").agg(F.count_if(F.col("band") == F.col("tile")).alias("low"), F.count("*").alias("high")).where(F.col("low") * F.col("high") > HOT)
    hot = small(stored(sized, "hot"))
    x, y = (side.join(hot.select("token", "tile"), ["token", "tile"], "left_anti").alias(name) for side, name in ((lower, "x"), (upper, "y")))
    ordered = "x.component <> y.component and (x.band < y.band or x.entity < y.entity) and if(x.n <= y.n, x.first, y.first)"
    pairs = x.join(y, F.expr(f"x.token = y.token and x.tile = y.tile and {ordered} and {_near('x', 'y', percent)}"))
    pairs = pairs.select(F.col("x.entity").alias("a"), F.col("y.entity").alias("b"))

    def blocks(side: DataFrame, number: int, own: str, other: str) -> DataFrame:
        mine, all_theirs = (F.ceil(F.col(c) / SIDE).cast("int") for c in (own, other))
        dealt = side.join(hot, ["token", "tile"]).withColumn("other", F.explode(F.sequence(F.lit(0), all_theirs - 1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("entity"), mine).cast("int"))
        names = ("own", "other") if own == "low" else ("other", "own")
        return dealt.select("token", "tile", *(F.col(c).alias(to) for c, to in zip(names, ("x_block", "y_block"), strict=True)), F.lit(number).alias("side"), "entity", "component", "n", "band", "first", "bits")

    cut = blocks(lower, 0, "low", "high").unionByName(blocks(upper, 1, "high", "low"))
    return pairs.unionByName(cut.groupBy("token", "tile", "x_block", "y_block").applyInArrow(_block_pairs(percent), "a bigint, b bigint"))


def near_components(documents: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of documents.

    Words are what lies between ASCII white space, A-Z lower-cased; a set is a
    text's distinct k-word shingles, or its whole sequence if it has fewer words.
    Two documents link when 100 * intersection >= percent * union. component_id
    is the smallest doc_id that links reach. A null text or one without words
    links with nothing. Rows with a null doc_id link with nothing and have a null
    component. Rows that repeat a doc_id are documents each.

    An empty table gives an empty one. Broadcast are the shingle counts by hash
    bucket and a filter of the shared shingles, both of bounded size, and tables
    of hashes and ids of at most 8 MB each.
    """
    with batches_of(documents.sparkSession, 1000):
        labels = stored(_components(documents, k, percent), "labels")
        least = small(stored(labels.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")), "least"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return labels.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _components(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, entity, component: one row per row of documents; a component is named by one of its sets."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(docs.mapInArrow(_sets(k), "doc_id bigint, n bigint, entity bigint, segment int, counts binary"), "sets")
    sets = rows.where("segment is null").select("doc_id", "n", "entity")
    rarity = spark.sparkContext.broadcast(_rarity(_bucket_counts(rows)))
    known = docs.where("doc_id is not null")
    prefixes = stored(known.select(_prefixes(k, percent, rarity)(F.col("text")).alias("p")).select("p.*").where("n > 0"), "prefixes")

    # entries of shingles that different sets share; `first`: whether it is among the set's first few
    every = prefixes.select(F.posexplode("tokens").alias("at", "token"), "entity", "few").select("token", "entity", (F.col("at") < F.col("few")).alias("first"))
    shared = every.groupBy("token").agg(F.min("entity").alias("low"), F.max("entity").alias("high"), F.max("first").alias("first")).where("low < high and first").select("token")
    shared = stored(shared, "shared")
    bits = bloom.bits_for(shared.count(), 16)
    held = spark.sparkContext.broadcast(bloom.merged(shared.mapInArrow(_token_filter(bits), bloom.SHAPE), bits, "once"))
    maybe = prefixes.select("entity", "band", F.explode(_held_tokens(held, bits)(F.col("tokens"), F.col("few"))).alias("t")).select("t.token", "entity", "band", "t.first")
    entries = stored(maybe.distinct().join(small(shared), "token", "left_semi"), "entries")
    named = small(stored(entries.select("entity").distinct(), "named"))
    signatures = prefixes.select("entity", "n", "band", "bits").join(named, "entity", "left_semi")
    signatures = stored(signatures.dropDuplicates(["entity"]), "signatures")
    release(prefixes, shared, named)
    x, y = signatures.alias("x"), signatures.alias("y")
    ids = stored(sets.where("n > 0 and doc_id is not null").groupBy("entity").agg(F.min("doc_id").alias("doc_id")), "ids")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link; only the texts that they name are hashed again, each once."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
        asked = stored(ids.join(asked, "entity", "left_semi"), "asked")
        found = known.join(small(asked), "doc_id").select("entity", _shingles(k)(F.col("text"), F.col("entity")).alias("set")).where("set is not null")
        found = stored(found.dropDuplicates(["entity"]), "arrays")
        left, right = found.select(F.col("entity").alias("a"), F.col("set").alias("left")), found.select(F.col("entity").alias("b"), F.col("set").alias("right"))
        links = stored(pairs.join(left, "a").join(right, "b").where(_linked(percent)(F.col("left"), F.col("right"))).select("a", "b"), "links")
        release(asked, found, pairs)
        return links

    def labelled(found: DataFrame | None) -> DataFrame:
        if found is None:
            return entries.withColumn("component", F.col("entity"))
        return entries.join(found.withColumnRenamed("node", "entity"), "entity", "left").withColumn("component", F.coalesce("component", "entity"))

    # each set and the leaders of its tiles; of those that the bitmaps allow, the nearest
    found = None
    for turn in range(ROUNDS):
        now = labelled(None) if found is None else stored(labelled(found), "labelled")
        drawn = F.min(F.struct(F.xxhash64("entity", "token", F.lit(turn)).alias("draw"), "entity", "component"))
        leaders = stored(now.groupBy("token", "band").agg(drawn.alias("l")).select("token", "band", F.col("l.entity").alias("leader"), F.col("l.component").alias("to")), "leaders")
        stars = now.join(leaders, ["token", "band"]).where("component <> to").select("entity", "leader").distinct()
        allowed = stars.join(x, F.col("x.entity") == stars["entity"]).join(y, F.col("y.entity") == stars["leader"]).where(_near("x", "y", percent))
        nearest = F.min(F.struct((F.expr(_differing("x", "y")) / F.expr("x.n + y.n")).alias("apart"), "leader")).alias("l")
        first = stored(allowed.groupBy(F.col("x.entity").alias("a")).agg(nearest).select("a", F.col("l.leader").alias("b")), "stars")
        release(leaders, None if found is None else now)
        links = verified(first)
        found = small(components(links) if found is None else joined_up(found, links))
        release(links)

    # tiles again, for pairs whose components still differ
    rest = stored(labelled(found), "labelled")
    mixed = rest.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("first").alias("first")).where("low < high and first").select("token")
    short = signatures.select("entity", "n", F.expr(_shortened("bits", TILE_WORDS)).alias("bits"))
    mixed = stored(mixed, "mixed")
    open_tiles = stored(rest.join(small(mixed), "token", "left_semi").join(short, "entity"), "tiles")
    pairs = _tile_pairs(open_tiles, percent).distinct()
    pairs = pairs.join(x, F.col("x.entity") == F.col("a")).join(y, F.col("y.entity") == F.col("b")).where(_near("x", "y", percent))
    pairs = stored(pairs.select("a", "b"), "pairs")
    release(rest, mixed, open_tiles, entries)
    links = verified(pairs)
    found = small(joined_up(found, links))
    release(links, signatures, ids)

    return sets.join(found.withColumnRenamed("node", "entity"), "entity", "left").select("doc_id", "n", "entity", F.coalesce("component", "entity").alias("component"))


def one_of_each(documents: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component: a row of its smallest doc_id.

    Rows that repeat a doc_id are documents each: the set of words of each of
    them decides. Rows without words, and rows with a null doc_id, stay.
    """
    own = [F.col(f"`{c}`") for c in documents.columns]
    with batches_of(documents.sparkSession, 1000):
        labels = stored(_components(documents, k, percent).where("doc_id is not null"), "labels")
        worded = labels.where("n > 0")
        first = small(stored(worded.groupBy("component").agg(F.min(F.struct("doc_id", "entity")).alias("first")), "first"))
        repeated = small(stored(labels.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated"))
        gone = worded.join(first, "component").where(F.struct("doc_id", "entity") != F.col("first")).select("doc_id")
        if repeated.isEmpty():
            return documents.join(gone.distinct(), "doc_id", "left_anti").select(*own)
        rest = documents.join(gone.unionByName(repeated).distinct(), "doc_id", "left_anti").select(*own)
        mark = fresh(documents.columns, "mark")
        again = documents.join(repeated, "doc_id", "left_semi").select(*own, _entities(k)(F.col("text").cast("string")).alias(mark))
        again = stored(again, "again")
    # of equal sets under one doc_id, one row by hash; gathered before the shuffle, so that a hot one costs a row a task
    kept = again.where(f"{mark}.n > 0").join(first.select("first.doc_id", F.col("first.entity").alias("of")), "doc_id").where(f"{mark}.entity = of")
    kept = kept.groupBy("doc_id", "of").agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("row")).select("row.*")
    return rest.unionByName(again.where(f"{mark}.n = 0").select(*own)).unionByName(kept)
