"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector's code is the signs of its coordinates after random rotations, packed
into bits, with two scalars: its norm, and how well the signs align with it.
From these an inner product is estimated without bias, and the spread of the
error is known. In each block of candidates the vectors whose upper bound
reaches the k-th best lower bound are reranked with the original vectors.

Queries and candidates are dealt into blocks of bounded size and every query
block meets every candidate block, so all rows are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES, CANDIDATES = 2048, 16_384


def rotations(dim: int, bits: int, seed: int) -> np.ndarray:
    """dim x bits: enough random rotations side by side for that many code bits."""
    random = np.random.default_rng([seed, dim])
    parts = [np.linalg.qr(random.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(parts, 1)[:, :bits]


def _encode(bits: int, seed: int):
    @F.arrow_udf("struct<code:binary,norm:double,align:double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            lists = [np.asarray(v, np.float64) for v in vectors.to_pylist()]
            codes, norms, aligns = [b""] * len(lists), np.zeros(len(lists)), np.zeros(len(lists))
            for dim in {len(v) for v in lists}:
                at = [i for i, v in enumerate(lists) if len(v) == dim]
                x = np.stack([lists[i] for i in at])
                norm = np.sqrt((x * x).sum(1))
                turned = x @ rotations(dim, bits, seed) / norm[:, None]
                packed = np.packbits(turned > 0, axis=1)
                norms[at], aligns[at] = norm, np.abs(turned).sum(1) * (dim / bits) / np.sqrt(dim)
                for i, row in zip(at, packed, strict=True):
                    codes[i] = row.tobytes()
            yield pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(norms), pa.array(aligns)], ["code", "norm", "align"])

    return encode


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Summed component after component, so that the last bit does not hang on the machine."""
    total = np.zeros(len(vectors))
    for i, x in enumerate(query):
        total += vectors[:, i] * x
    return total


def _search(k: int, bits: int, seed: int, width: float):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        if not left.num_rows or not right.num_rows:
            return empty
        as_matrix = lambda column: np.asarray(column.combine_chunks().flatten(), np.float64).reshape(len(column), -1)
        queries, vectors = as_matrix(left["q_vector"]), as_matrix(right["vector"])
        dim = queries.shape[1]
        query_ids, ids = left["q_id"].to_numpy(), right["id"].to_numpy()
        norm, align = right["norm"].to_numpy(), right["align"].to_numpy()
        packed = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        signs = np.unpackbits(packed, axis=1)[:, :bits].astype(np.float32)
        signs = (signs * 2 - 1).T.copy()
        turned = (queries @ rotations(dim, bits, seed)).astype(np.float32)
        query_norm = np.sqrt((queries * queries).sum(1))
        # <signs, q> / sqrt(dim) * (dim / bits) estimates align * <v, q> / |v|
        scale = (norm / align * (dim / bits) / np.sqrt(dim)).astype(np.float32)
        spread = (norm * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(max(bits - 1, 1)) * width).astype(np.float32)
        out = [[], [], []]
        for low in range(0, len(queries), 128):
            estimate = turned[low : low + 128] @ signs
            estimate *= scale
            for q in range(len(estimate)):
                i, error = low + q, spread * np.float32(query_norm[low + q])
                bound = estimate[q] - error
                bound[ids == query_ids[i]] = -np.inf
                least = np.partition(bound, len(bound) - k - 1)[len(bound) - k - 1] if len(bound) > k else -np.inf
                near = np.flatnonzero((estimate[q] + error >= least) & (ids != query_ids[i]))
                score = inner_products(vectors[near], queries[i])
                best = np.lexsort((ids[near], -score))[:k]
                out[0].append(np.full(len(best), query_ids[i]))
                out[1].append(ids[near][best])
                out[2].append(score[best])
        return pa.table([pa.array(np.concatenate(x), t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names)

    return search


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(embeddings: DataFrame, queries: Column, *, k: int = 20, bits: int = 256, width: float = 3.0, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each query row.

    `queries` says which rows are queries; every row but the query's own is a
    candidate. Scores are exact, in double precision; ties go to the smaller
    vec_id. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do rows with a null vec_id; only vectors of equal length
    meet. Rows that repeat a vec_id are candidates each, but a pair of ids is
    returned once, with its largest score. `width` is the number of standard
    errors of the bounds: at 3, about one true neighbour in a thousand can be
    missed.
    """
    own = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    own = own.select(F.col("vec_id").cast("bigint").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    own = own.withColumn("dim", F.size("vector")).withColumn("n", F.xxhash64("id"))
    sizes = own.groupBy("dim").agg(F.count("*").alias("rows"), F.count_if("asks").alias("asking"))
    # the number of blocks of each length of vectors: a row a length, joined, so it is not bounded by the driver
    sizes = sizes.select("dim", F.ceil(F.col("rows") / CANDIDATES).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("asking") / QUERIES)).alias("groups"))
    dealt = own.join(sizes, "dim")
    asking = dealt.where("asks").select("dim", F.pmod("n", "groups").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "id", "vector")
    coded = dealt.withColumn("code", _encode(bits, seed)(F.col("vector"))).where("code.norm > 0 and code.norm < double('infinity')")
    held = coded.select("dim", F.pmod("n", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("group"), "id", "vector", "code.code", "code.norm", "code.align")
    asking = asking.select(F.col("dim").alias("q_dim"), F.col("group").cast("int").alias("q_group"), F.col("block").alias("q_block"), F.col("id").alias("q_id"), F.col("vector").alias("q_vector"))
    found = asking.groupBy("q_dim", "q_group", "q_block").cogroup(held.groupBy("dim", "group", "block")).applyInArrow(_search(k, bits, seed, width), "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
