"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes. In each a forward and a backward network
run, every byte gets class probabilities from both states, and a document's
probabilities are the mean over all its bytes. Gates are piecewise linear, so a
step is a few array operations on thousands of windows at a time. Training is
backpropagation through time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bytetext import slices
from ledgerloom.llm.quality import held_out, whole_texts
from ledgerloom.llm.scratch import fresh

WINDOW, PAD = 96, 256


@dataclass
class Net:
    """Parameters; the first axis of inputs, states and shift is the direction."""

    inputs: np.ndarray  # 2, 257, 3 H: what each byte adds to the update, reset and candidate gates
    states: np.ndarray  # 2, H, 3 H
    layer: np.ndarray  # 2 H, classes
    bias: np.ndarray
    classes: list[str]

    @property
    def all(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.layer, self.bias]


def new_net(classes: list[str], hidden: int, seed: int = 11) -> Net:
    random = np.random.default_rng(seed)
    make = lambda scale, *shape: (random.standard_normal(shape) * scale).astype(np.float32)
    return Net(make(0.5, 2, PAD + 1, 3 * hidden), make(0.5 / hidden**0.5, 2, hidden, 3 * hidden), make(0.5, 2 * hidden, len(classes)), np.zeros(len(classes), np.float32), classes)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by step and window, padded, and the row of each window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[rows] + number * WINDOW
    at = begin + np.arange(WINDOW)[:, None]
    inside = at < offsets[rows + 1]
    cells = np.full(at.shape, PAD, np.int16)
    cells[inside] = data[at[inside]]
    return cells, rows


def run(net: Net, cells: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of both directions at every step (steps, windows, 2 H), and what training needs."""
    steps, n = cells.shape
    size = net.states.shape[1]
    found = np.empty((steps, n, 2 * size), np.float32)
    trail: list = [None, None]
    for way in (0, 1):
        inputs, states, h = net.inputs[way], net.states[way], np.zeros((n, size), np.float32)
        path = []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x = inputs[cells[t]]
            own = h @ states
            gates = x[:, : 2 * size]
            gates += own[:, : 2 * size]
            np.clip(gates, -2, 2, out=gates)
            gates *= 0.25
            gates += 0.5
            z, r = gates[:, :size], gates[:, size:]
            c = own[:, 2 * size :] * r
            c += x[:, 2 * size :]
            np.clip(c, -1, 1, out=c)
            new = h - c
            new *= z
            new += c
            if keep:
                path.append((t, h, own, z, r, c))
            h = new
            found[t, :, way * size : (way + 1) * size] = h
        trail[way] = path
    return found, trail


def probabilities(net: Net, found: np.ndarray) -> np.ndarray:
    logits = found @ net.layer
    logits += net.bias
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def gradients(net: Net, cells: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the bytes, and its gradients, back through time."""
    size = net.states.shape[1]
    found, trail = run(net, cells, keep=True)
    p = probabilities(net, found)
    real = (cells != PAD).astype(np.float32)
    total = max(1.0, float(real.sum()))
    columns = np.arange(cells.shape[1])
    loss = -float((np.log(np.maximum(p[:, columns, labels], 1e-9)) * real).sum()) / total
    p[:, columns, labels] -= 1
    p *= real[:, :, None] / total
    flat = p.reshape(-1, p.shape[-1])
    g_layer, g_bias = found.reshape(-1, 2 * size).T @ flat, flat.sum(0)
    from_above = p @ net.layer.T
    g_inputs, g_states = np.zeros_like(net.inputs), np.zeros_like(net.states)
    for way in (0, 1):
        states, back = net.states[way], np.zeros((cells.shape[1], size), np.float32)
        for t, h, own, z, r, c in reversed(trail[way]):
            back = back + from_above[t, :, way * size : (way + 1) * size]
            d_c = back * (1 - z) * (np.abs(c) < 1)
            d_z = back * (h - c) * 0.25 * ((z > 0) & (z < 1))
            d_r = d_c * own[:, 2 * size :] * 0.25 * ((r > 0) & (r < 1))
            into_own = np.concatenate((d_z, d_r, d_c * r), 1)
            into_x = np.concatenate((d_z, d_r, d_c), 1)
            g_states[way] += h.T @ into_own
            np.add.at(g_inputs[way], cells[t], into_x)
            back = back * z + into_own @ states.T
    return loss, [g_inputs, g_states, g_layer, g_bias]


def train(texts: list[str], langs: list[str], *, hidden: int = 8, steps: int = 160, batch: int = 192, rate: float = 0.02, seed: int = 11) -> Net:
    """Fits on the windows of a bounded sample, each class equally often."""
    classes = sorted(set(langs))
    net, random = new_net(classes, hidden, seed), np.random.default_rng(seed)
    if len(classes) < 2:
        return net
    cells, labels = [], []
    for low, _, data, offsets in slices(pa.array(texts, pa.string())):
        own, rows = windows(data, offsets)
        cells.append(own)
        labels.append(np.array([classes.index(langs[low + r]) for r in rows], np.int64))
    cell, label = np.concatenate(cells, 1), np.concatenate(labels)
    by_class = [np.flatnonzero(label == i) for i in range(len(classes)) if (label == i).any()]
    first, second = [np.zeros_like(x) for x in net.all], [np.zeros_like(x) for x in net.all]
    for step in range(1, steps + 1):
        pick = np.concatenate([random.choice(x, max(1, batch // len(by_class))) for x in by_class])
        _, found = gradients(net, cell[:, pick], label[pick])
        now = rate * (1 - step / (steps + 1))
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        for p, g, m, v in zip(net.all, found, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def learn(documents: DataFrame, *, most_rows: int = 1600, most_bytes: int = 32_000_000, most_langs: int = 1000) -> Net:
    """A network for the languages that `lang` names, from about `most_rows` documents, never more than twice as many.

    Only rows with a text and a lang whose crc32 of the doc_id as text does not
    leave 2 by 4 teach; each language gives up to its equal part, by hash of
    doc_id. Whole texts teach, `most_bytes` in all: a document that no longer
    fits is passed over. The `most_langs` most frequent languages (ties: by
    name) are learned, from 4 documents each at least. Without any row that
    teaches, as in an empty table, `und` is the one language.
    """
    known = documents.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id", 4, 2))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return new_net(["und"], 1)
    each = max(4, most_rows // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    sample = whole_texts(picked.select("lang", "text", "doc_id"), 2 * max(most_rows, 4 * len(counts)), most_bytes)
    return train(sample["text"].to_pylist(), sample["lang"].to_pylist())


def document_probabilities(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over the bytes of each row; zero rows for empty texts."""
    total = np.zeros((len(offsets) - 1, len(net.classes)))
    cells, rows = windows(data, offsets)
    for low in range(0, len(rows), 2048):
        own = cells[:, low : low + 2048]
        p = probabilities(net, run(net, own)[0])
        p *= (own != PAD)[:, :, None]
        np.add.at(total, rows[low : low + 2048], p.sum(0))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _predict(net: Net):
    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = [], []
            for _, _, data, offsets in slices(texts):
                p = document_probabilities(net, data, offsets)
                best = p.argmax(1)
                langs += [net.classes[i] for i in best]
                scores.append(p[np.arange(len(p)), best])
            score = np.clip(np.concatenate(scores) if scores else np.zeros(0), 0, 1)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return predict


def identified(documents: DataFrame, net: Net, *, out: str = "language") -> DataFrame:
    """documents with a struct of lang and score (its mean probability).

    A null text, or one without a letter, is `und` with score 0. Rows keep their
    number and their other columns.
    """
    named = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found, own = fresh([*documents.columns, out], "found"), [F.col(f"`{c}`") for c in documents.columns]
    done = documents.withColumn(found, _predict(net)(F.col("text")))
    lang = F.when(named, F.col(f"{found}.lang")).otherwise("und").alias("lang")
    return done.select(*own, F.struct(lang, F.when(named, F.col(f"{found}.score")).otherwise(0.0).alias("score")).alias(fresh(documents.columns, out)))
