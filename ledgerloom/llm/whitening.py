"""Whitening of embeddings by a one-sided Jacobi SVD.

Tasks reduce blocks of centred rows to triangular factors R, which are stacked
and reduced again, some at a time, until one is left. Plane rotations make R's
columns orthogonal; the rotations, multiplied up, hold the components, and the
columns' lengths the standard deviations, accurate even where they are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import release, stored
from ledgerloom.llm.vectors import LARGEST, as_long, exact_sums, finite, matrix, scaled, widest

FAN_IN = 32  # factors that one task stacks
BLOCK = 4096  # rows that are reduced at a time


def _triangles(dim: int, mean: np.ndarray):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, dim))
        for batch in batches:
            rows = matrix(batch.column(0), dim) - mean
            for low in range(0, len(rows), BLOCK):
                held = np.linalg.qr(np.concatenate((held, rows[low : low + BLOCK])), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()] if len(held) else [], pa.binary())], ["r"])

    return reduce


def _stacked(dim: int):
    def stack(part: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(r, np.float64).reshape(-1, dim) for r in part["r"].to_pylist()])
        return pa.table({"r": pa.array([np.linalg.qr(rows, mode="r").tobytes()], pa.binary())})

    return stack


def triangle(fit: DataFrame, dim: int, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows: dim x dim at most, the only thing that reaches the driver."""
    parts = stored(fit.select("x").mapInArrow(_triangles(dim, mean), "r binary"), "triangles")
    left = parts.count()
    while left > 1:
        last, left = parts, -(-left // FAN_IN)
        dealt = parts.withColumn("at", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(left)))
        parts = stored(dealt.groupBy("at").applyInArrow(_stacked(dim), "r binary"), "triangles")
        left = parts.count()  # the numbers are no gapless ones, so a group may be empty
        release(last)
    found = parts.first()
    release(parts)
    return np.frombuffer(found.r, np.float64).reshape(-1, dim) if found else np.zeros((0, dim))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions: columns of `r` turned against each other until all are orthogonal, longest first.

    r @ directions has orthogonal columns of these lengths. A pair is turned if the
    cosine between its columns passes rounding.
    """
    r = np.array(r, np.float64)
    dim = r.shape[1]
    scale = np.abs(r).max(initial=0.0) or 1.0
    a, v = np.asfortranarray(r / scale), np.asfortranarray(np.eye(dim))
    for _ in range(sweeps):
        turned = False
        for p in range(dim - 1):
            for q in range(p + 1, dim):
                x, y = a[:, p], a[:, q]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= 1e-15 * np.sqrt(xx * yy) or xy == 0:
                    continue
                turned = True
                z = (yy - xx) / (2 * xy)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    one = m[:, p].copy()
                    m[:, p] = c * one - s * m[:, q]
                    m[:, q] = s * one + c * m[:, q]
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(0)) * scale
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def _spread(dim: int, mean: np.ndarray, turn: np.ndarray):
    """A task's count, sums and centred products of whitened rows, the latter moved to the origin."""
    k = turn.shape[1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (matrix(batch.column(0), dim) - mean) @ turn
            own = y.mean(0) if len(y) else np.zeros(k)
            total, sums = total + len(y), sums + own * len(y)
            products += (y - own).T @ (y - own) + len(y) * np.outer(own, own)
        names = ["n", "sums", "products"]
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], names)

    return spread


def identity_error(fit: DataFrame, dim: int, mean: np.ndarray, turn: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = turn.shape[1]
    parts = fit.select("x").mapInArrow(_spread(dim, mean, turn), "n bigint, sums array<double>, products array<double>")
    add = lambda c, n: [F.sum(F.col(c)[i]).alias(f"{c}{i}") for i in range(n)]
    total = parts.agg(F.sum("n").alias("n"), *add("sums", k), *add("products", k * k)).first()
    centre = np.array([total[f"sums{i}"] for i in range(k)]) / total["n"]
    products = np.array([total[f"products{i}"] for i in range(k * k)]).reshape(k, k) / total["n"]
    return float(np.abs(products - np.outer(centre, centre) - np.eye(k)).max(initial=0.0))


def _rows(dim: int, n: int, sums: list[int], mean: np.ndarray, turn: np.ndarray, live: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, k = np.array(sums, object), turn.shape[1]
        for batch in batches:
            x = matrix(batch.column(1), dim)
            if len(x) and widest(x) * n + max(map(abs, sums), default=0) < int((LARGEST // dim) ** 0.5):
                d = x * n - s.astype(np.int64)
                deviation = (d * d).sum(1)
            else:
                d = x.astype(object) * n - s
                deviation = as_long((d * d).sum(1)) if len(x) else np.zeros(0, np.int64)
            y = (x - mean) @ turn
            whitened = pa.array(y.ravel().tolist(), pa.float64()) if live == k else pa.array([v if i < live else None for row in y.tolist() for i, v in enumerate(row)], pa.float64())
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.repeat(deviation, k), pa.int64()), whitened], ["vec_id", "component", "deviation", "whitened"])

    return rows


def whitened(embeddings: DataFrame, *, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Vectors become x = floor(scale * c). The fit list is each distinct x once: n
    of them, with sums S. `component` counts unit eigenvectors of their
    covariance from the largest eigenvalue e; `whitened` is x - S / n on it, over
    sqrt(e); `explained` is e over the covariance's trace, and `deviation` the
    exact sum of (n * x - S) squared. `identity_error` says how far the
    covariance of the whitened fit list is from the identity.

    Vectors that are null or hold null or non-finite components are left out, and
    so are those of another length than the commonest (ties: the longer), as no
    covariance holds both, and empty ones. Rows that repeat a vec_id, or lack one,
    are rows each. Other columns are not looked at. An empty table gives an empty
    one. A component along which nothing varies has null in `whitened` and takes
    no part in `identity_error`. A deviation that passes a long is held to the
    largest long. Eigenvalues that are equal may share their space in any way.

    One shuffle finds the distinct vectors; n sums, R and a k x k covariance
    reach the driver.
    """
    spark, vector = embeddings.sparkSession, F.col("embedding")
    good = embeddings.where(finite(vector) & (F.size(vector) > 0))
    most = good.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    dim = most.dim
    good = good.where(F.size(vector) == dim).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(vector, scale).alias("x"))
    fit = stored(good.select("x").distinct(), "fit")
    n, sums = exact_sums(fit.select("x", F.lit(0).alias("group"), F.lit(1).cast("bigint").alias("sign")), dim)[0]
    mean = np.array([s / n for s in sums])
    lengths, directions = jacobi(triangle(fit, dim, mean))
    trace = float((lengths**2).sum())
    k = min(components, dim)
    live = int((lengths[:k] > 1e-13 * max(lengths[0], 1e-300)).sum()) if trace else 0
    deviations = np.ones(k)
    deviations[:live] = lengths[:live] / np.sqrt(n)
    turn = directions[:, :k] / deviations
    error = identity_error(fit, dim, mean, turn[:, :live]) if live else 0.0
    release(fit)
    found = good.mapInArrow(_rows(dim, n, sums, mean, turn, live), "vec_id bigint, component int, deviation bigint, whitened double")
    shares = F.array(*[F.lit(float(x * x / trace) if trace else 0.0) for x in lengths[:k]])
    return found.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
