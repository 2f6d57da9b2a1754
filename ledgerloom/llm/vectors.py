"""Integer vectors from embeddings, and exact sums of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs; what passes a long is held to the last one."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of equal lists of longs."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(held.flatten(), np.int64).reshape(-1, dim)


def widest(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def as_long(values) -> np.ndarray:
    """Exact integers as longs; what passes a long is held to the last one."""
    return np.array([min(int(v), LARGEST) for v in values], np.int64) if getattr(values, "dtype", None) == object else np.asarray(values, np.int64)


def _sums(dim: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            x, group, sign = matrix(batch.column(0), dim), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            narrow = widest(x) < LARGEST // max(len(x), 1)
            for g in np.unique(group).tolist():
                of = group == g
                rows = x[of] * sign[of, None] if narrow else x[of].astype(object) * sign[of, None].astype(object)
                total = held.setdefault(g, [0, [0] * dim])
                total[0] += int(sign[of].sum())
                total[1] = [a + int(b) for a, b in zip(total[1], rows.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([list(map(str, s)) for _, s in held.values()], pa.list_(pa.string()))], ["group", "n", "sums"])

    return add


def exact_sums(rows: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of the vectors of each group: `rows` holds x, an int and a long of +1 or -1 that says whether the row is added or taken off.

    Tasks add up what they hold; what reaches the driver is a number per group and component.
    """
    parts = rows.mapInArrow(_sums(dim), "group int, n bigint, sums array<string>")
    each = parts.select("group", "n", F.posexplode("sums").alias("i", "s"))
    total = each.groupBy("group", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in total.orderBy("group", "i").collect():
        found.setdefault(r["group"], (r["n"], []))[1].append(int(r["s"]))
    return found
