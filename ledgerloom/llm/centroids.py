"""Centroid clustering of integer vectors with Hamerly's bounds.

Each vector carries its cluster, one upper bound of its distance to that
centroid and one lower bound of its distance to any other. When centroids move,
the bounds are loosened by how far. Where the upper bound still lies under the
lower one, or under half the way to the nearest other centroid, the cluster
stands; else the distance to the own centroid is worked out anew, and where that
decides nothing either, the distances to all. Distances are exact integers, and
bounds are rounded away from each other, so that ties always reach the full scan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import release, stored
from ledgerloom.llm.vectors import LARGEST, as_long, exact_sums, finite, matrix, scaled, widest

UP, DOWN = 1 + 2.0**-40, 1 - 2.0**-40
STATE = "vec_id bigint, x array<bigint>, was int, cluster int, upper double, lower double"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to y (a row, or a row each): longs where they surely fit, else Python integers."""
    room = math.isqrt((1 << 61) // max(x.shape[-1], 1))
    if max(widest(x), widest(y)) < room // 2:
        d = x - y
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - y.astype(object)
    return (d * d).sum(-1)


def _root(d) -> np.ndarray:
    return np.sqrt(np.asarray(d, np.float64))


class Centroids:
    """Centroids, how far each moved, and half the way of each to its nearest other."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows = rows
        self.moved = np.array([self._far(a, b) * UP for a, b in zip(rows, before, strict=True)]) if before else np.zeros(len(rows))
        half = [min((self._far(a, b) for j, b in enumerate(rows) if j != i), default=math.inf) for i, a in enumerate(rows)]
        self.half = np.array(half) / 2 * DOWN
        # how far any other centroid moved, for each
        order = np.sort(self.moved)
        self.others = np.where(self.moved == order[-1], order[-2] if len(rows) > 1 else 0.0, order[-1]) if np.sum(self.moved == order[-1]) == 1 else np.full(len(rows), order[-1])

    @staticmethod
    def _far(a: list[int], b: list[int]) -> float:
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))

    def array(self) -> np.ndarray:
        return np.array(self.rows, np.int64)


def _assign(centroids: Centroids, dim: int, measure: bool):
    """Moves a task's vectors to their nearest centroids; with `measure`, returns distances in the place of the state."""

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.stack([squared(x, c) for c in centroids.array()])
        at = np.argmin(d, 0)  # the first of equals
        own = d[at, np.arange(len(x))]
        rest = d.astype(np.float64)
        rest[at, np.arange(len(x))] = np.inf
        return at, own, _root(rest.min(0)) * DOWN

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = centroids.array()
        for batch in batches:
            ids, lists, was = batch.column(0), batch.column(1), batch.column(3)
            x = matrix(lists, dim)
            cluster = was.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            upper = batch.column(4).fill_null(np.inf).to_numpy(zero_copy_only=False).copy()
            lower = batch.column(5).fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()
            known = cluster >= 0
            upper[known] = (upper[known] + centroids.moved[cluster[known]]) * UP
            lower[known] = lower[known] - centroids.others[cluster[known]] * UP
            lower[known] -= np.abs(lower[known]) * (UP - 1)
            safe = np.full(len(x), -np.inf)
            safe[known] = np.maximum(lower[known], centroids.half[cluster[known]])
            maybe = np.flatnonzero(known & ~(upper < safe))
            if len(maybe):
                upper[maybe] = _root(squared(x[maybe], centres[cluster[maybe]])) * UP
            open_ = np.flatnonzero(~(upper < safe))
            if len(open_):
                cluster[open_], own, lower[open_] = nearest(x[open_])
                upper[open_] = _root(own) * UP
            if measure:
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(as_long(squared(x, centres[cluster])), pa.int64())], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([ids, lists, was, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "x", "was", "cluster", "upper", "lower"])

    return assign


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256, in that order; rows without an id are none, equal ids go by their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.x) for r in vectors.where("vec_id is not null").select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()]


def clustered(embeddings: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row per vector of `dim` finite components.

    Vectors become floor(scale * x). `k` of them start as centroids; each round
    assigns every vector to the nearest one (ties: the smaller number) and moves
    each that has vectors to the floor of their mean. Then vectors are assigned
    once more. With fewer vectors than `k` there are fewer clusters.

    Vectors that are null, of another length, or hold null or non-finite
    components are left out. Rows that repeat a vec_id, or lack one, are vectors
    each; those without one start no cluster. Other columns of the table are not
    looked at. An empty table gives an empty one. Squared distances and their
    sums that pass a long are held to the largest long; clusters stay exact.

    A round reads and writes the table of vectors with their bounds once, without
    a shuffle; only vectors that changed their cluster are added up again. What
    reaches the driver are k sums of `dim` components.
    """
    vector = F.col("embedding")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("was", "int"), ("cluster", "int"), ("upper", "double"), ("lower", "double"))]
    kept = embeddings.where(finite(vector) & (F.size(vector) == dim)).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(vector, scale).alias("x"), *none)
    state = stored(kept, "vectors")
    now = Centroids(seeds(state, k, seed) or [[0] * dim])
    count, total = [0] * len(now.rows), [[0] * dim for _ in now.rows]
    for _ in range(rounds):
        last, state = state, stored(state.mapInArrow(_assign(now, dim, False), STATE).select("vec_id", "x", F.col("was"), "cluster", "upper", "lower"), "vectors")
        release(last)
        moved = state.where("was is null or was <> cluster")
        one, out = F.lit(1).cast("bigint"), F.lit(-1).cast("bigint")
        changes = moved.select("x", F.col("cluster").alias("group"), one.alias("sign")).unionByName(moved.where("was is not null").select("x", F.col("was").alias("group"), out.alias("sign")))
        for c, (n, s) in exact_sums(changes, dim).items():
            count[c], total[c] = count[c] + n, [a + b for a, b in zip(total[c], s, strict=True)]
        rows = [[s // count[c] for s in total[c]] if count[c] else now.rows[c] for c in range(len(now.rows))]
        now = Centroids(rows, now.rows)
    done = stored(state.mapInArrow(_assign(now, dim, True), "vec_id bigint, cluster int, distance bigint"), "clusters")
    release(state)
    by = {r.cluster: int(r.far) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()}
    facts = [(c, min(by.get(c, 0), LARGEST), min(sum(by.values()), LARGEST), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(now.rows)]
    facts = done.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
