"""Clustering and whitening against brute force, with nulls, ties, repeats, huge components and odd lengths."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import centroids, whitening

SHAPE = "vec_id bigint, embedding array<double>"
NAN, INF = float("nan"), float("inf")
BAD = [(900, None), (901, [NAN, 1.0, 2.0]), (902, [INF, 1.0, 2.0]), (903, [None, 1.0, 2.0]), (904, [1.0]), (905, [])]


def brute_clusters(rows, k, rounds, scale, seed):
    held = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in held if i is not None)
    centres = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(centres)), key=lambda c: (far(x, centres[c]), c))
    for _ in range(rounds):
        of = [near(x) for _, x in held]
        groups = {c: [x for (_, x), o in zip(held, of) if o == c] for c in set(of)}
        centres = [[sum(d) // len(groups[c]) for d in zip(*groups[c])] if c in groups else m for c, m in enumerate(centres)]
    of = [(i, near(x), x) for i, x in held]
    d = [(i, c, far(x, centres[c])) for i, c, x in of]
    top = (1 << 63) - 1
    total = lambda keep: min(sum(f for _, c, f in d if keep(c)), top)
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centres]
    return sorted((i or 0, c, min(f, top), total(lambda o, c=c: o == c), total(lambda o: True), name[c]) for i, c, f in d)


@pytest.mark.parametrize("case", ["spread", "ties", "huge", "few"])
def test_clusters_match_brute_force(spark, case):
    r = np.random.default_rng(len(case))
    rows = [(i, [float(x) for x in r.standard_normal(3)]) for i in range(120)]
    if case == "ties":
        rows = [(i % 50, [float(x) for x in r.integers(-1, 2, 3)]) for i in range(150)] + [(None, [1.0, 1.0, 1.0])]
    if case == "huge":
        rows = [(i, [x * 1e12 for x in v]) for i, v in rows]
    rows = rows[:3] if case == "few" else rows
    table = spark.createDataFrame(rows + BAD, SHAPE).withColumn("cluster", F.lit("x"))
    got = sorted((x.vec_id or 0, *x[1:]) for x in centroids.clustered(table, k=5, rounds=4, dim=3, scale=16, seed=1).collect())
    assert got == brute_clusters(rows, 5, 4, 16, 1)


def test_clusters_of_nothing(spark):
    assert centroids.clustered(spark.createDataFrame(BAD, SHAPE), dim=3).count() == 0
    assert centroids.clustered(spark.createDataFrame([], SHAPE)).count() == 0


def brute_whitening(rows, k, scale):
    x = [[int(np.floor(scale * c)) for c in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))), float)
    n, s = len(fit), [sum(c) for c in zip(*sorted(set(map(tuple, x))))]
    mean = fit.mean(0)
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for (i, _), row in zip(rows, x):
        deviation = sum((n * a - b) ** 2 for a, b in zip(row, s))
        y = (np.array(row, float) - mean) @ v[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300))
        out += [(i or 0, c + 1, n, deviation, abs(y[c]), e[c] / e.sum()) for c in range(k)]
    return sorted(out)


def test_whitening_matches_brute_force(spark):
    r = np.random.default_rng(7)
    turn = np.linalg.qr(r.standard_normal((6, 6)))[0] * [9, 5, 3, 2, 1, 1e-2]
    rows = [(i, (r.standard_normal(6) @ turn.T).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(None, rows[1][1]), (5, [0.0] * 6)]
    table = spark.createDataFrame(rows + BAD, SHAPE).withColumn("component", F.lit("x")).repartition(7)
    found = whitening.whitened(table).collect()
    got = sorted((x.vec_id or 0, x.component, x.n, x.deviation, abs(x.whitened), x.explained) for x in found)
    want = brute_whitening(rows, 4, 256)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], rtol=1e-9, atol=1e-9)
    assert max(x.identity_error for x in found) < 1e-9
    signs = {}
    for x in found:  # one sign for all rows of a component: equal vectors have equal figures
        if x.vec_id in (0, 300):
            signs.setdefault(x.component, set()).add(round(x.whitened, 9))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_spread(spark):
    same = whitening.whitened(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], SHAPE)).collect()
    assert [(x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in same] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)] * 2
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], SHAPE)).collect()
    assert {(x.component, x.whitened is None) for x in line} == {(1, False), (2, True)}
    wide = whitening.whitened(spark.createDataFrame([(i, [i * 1e12, float(i)]) for i in range(5)], SHAPE)).collect()
    assert max(x.deviation for x in wide) == (1 << 63) - 1 and max(x.identity_error for x in wide) < 1e-9
    assert whitening.whitened(spark.createDataFrame([], SHAPE)).count() == 0


def test_jacobi_is_accurate_on_small_deviations():
    r = np.random.default_rng(3).standard_normal((8, 8)) * 10.0 ** -np.arange(8)
    lengths, turn = whitening.jacobi(np.linalg.qr(r, mode="r"))
    assert np.allclose(turn.T @ turn, np.eye(8), atol=1e-13)
    assert np.allclose(lengths, np.linalg.svd(r)[1], rtol=1e-8)
