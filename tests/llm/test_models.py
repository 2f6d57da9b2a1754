"""The language network and the quality classifier against plain loops over bytes, words and numbers."""

import math
import random

import numpy as np
import pytest

from ledgerloom.llm import bytetext, language, quality

DOCS = "doc_id bigint, text string"
WORD = (1 << 64) - 1
TEXTS = ["the cat sat on the mat", "a a a b b", "", None, "é日 本語 x", "  tabs\tand\nlines ", "ab", "one", "x" * 97, "the quick brown fox " * 30, "ÄÖ ü " * 60, "the cat sat on the mat"]


def softmax(logits):
    most = max(logits)
    e = [math.exp(x - most) for x in logits]
    return [x / sum(e) for x in e]


def plain_states(net, cells, way):
    """The state after each byte of one window, read in one direction, a number at a time."""
    size, h, found = net.states.shape[1], [0.0] * net.states.shape[1], {}
    for t in range(len(cells)) if way == 0 else reversed(range(len(cells))):
        x, u = net.inputs[way][cells[t]].tolist(), net.states[way].tolist()
        own = [sum(h[i] * u[i][j] for i in range(size)) for j in range(3 * size)]
        gate = [min(2, max(-2, x[j] + own[j])) / 4 + 0.5 for j in range(2 * size)]
        c = [min(1, max(-1, own[2 * size + j] * gate[size + j] + x[2 * size + j])) for j in range(size)]
        h = found[t] = [gate[j] * h[j] + (1 - gate[j]) * c[j] for j in range(size)]
    return found


def plain_language(net, text):
    data, total = (text or "").encode(), [0.0] * len(net.classes)
    for low in range(0, len(data), language.WINDOW):
        own = list(data[low : low + language.WINDOW])
        cells = own + [language.PAD] * (language.WINDOW - len(own))
        there, back = plain_states(net, cells, 0), plain_states(net, cells, 1)
        for t in range(len(own)):
            state = there[t] + back[t]
            logits = [float(net.bias[k]) + sum(s * float(net.layer[i, k]) for i, s in enumerate(state)) for k in range(len(net.classes))]
            total = [a + p for a, p in zip(total, softmax(logits), strict=True)]
    mean = [x / max(1, len(data)) for x in total]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    return net.classes[mean.index(max(mean))], max(mean)


def test_languages_match_plain_loops(spark):
    net = language.new_net(["a", "b", "c"], 3, seed=2)
    got = {r.doc_id: tuple(r.language) for r in language.identified(spark.createDataFrame(list(enumerate(TEXTS)), DOCS), net).collect()}
    for i, text in enumerate(TEXTS):
        lang, score = plain_language(net, text)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-5)


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD
    return x ^ x >> 31


def plain_hash(data):
    total, power = 0, 1
    for b in data:
        total, power = (total + int(bytetext._BYTE[b]) * power) & WORD, power * int(bytetext._BASE) & WORD
    return mixed(total)


def plain_features(text):
    text = text or ""
    words = [plain_hash(w) for w in text.encode().split()]
    found = list(words)
    found += [mixed(0x5EED) if a == b else mixed((a * 3 + b + 1) & WORD) for a, b in zip(words, words[1:])]
    for n in (3, 4):
        found += [plain_hash(text[i : i + n].encode()) ^ (n << 60) for i in range(len(text) - n + 1)]
    return [x >> (64 - quality.BUCKET_BITS) for x in found]


def test_scores_match_plain_loops(spark):
    weights = np.random.default_rng(3).standard_normal(1 << quality.BUCKET_BITS).astype(np.float32)
    model = quality.Model(weights, 0.25)
    got = {r.doc_id: r.quality_score for r in quality.scored(spark.createDataFrame(list(enumerate(TEXTS)), DOCS), model).collect()}
    for i, text in enumerate(TEXTS):
        own = plain_features(text)
        mean = sum(float(weights[f]) for f in own) / max(1, len(own))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-mean - 0.25)), abs=1e-6)


def test_training_matches_plain_loops():
    r = random.Random(4)
    texts = [" ".join(r.choice(["good", "fine", "text", "bad", "junk", "junk"]) for _ in range(r.randrange(1, 9))) for _ in range(12)] + [""]
    labels, dim, epochs, rate, seed = [r.randrange(2) for _ in texts], 4, 3, 0.6, 7
    model = quality.train(texts, labels, 0.5, dim=dim, epochs=epochs, rate=rate, seed=seed)
    order = np.random.default_rng(seed)
    start = order.uniform(-1 / dim, 1 / dim, (1 << quality.BUCKET_BITS, dim)).astype(np.float32)
    rows = [plain_features(t) for t in texts]
    table = {f: start[f].astype(float).tolist() for own in rows for f in own}
    layer, bias, done = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0], 0
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own, step = rows[i], rate * (1 - done / (epochs * len(rows)))
            done += 1
            mean = [sum(table[f][d] for f in own) / max(1, len(own)) for d in range(dim)]
            p = softmax([sum(mean[d] * layer[d][k] for d in range(dim)) + bias[k] for k in (0, 1)])
            p[labels[i]] -= 1
            back = [sum(layer[d][k] * p[k] for k in (0, 1)) for d in range(dim)]
            for k in (0, 1):
                bias[k] -= step * 0.1 * p[k]
                for d in range(dim):
                    layer[d][k] -= step * mean[d] * p[k]
            for f in own:  # a feature that occurs twice is moved twice
                table[f] = [x - step * 20 / len(own) * b for x, b in zip(table[f], back, strict=True)]
    for f, vector in table.items():
        assert model.weights[f] == pytest.approx(sum(x * (layer[d][1] - layer[d][0]) for d, x in enumerate(vector)), abs=1e-3)
    share = sum(labels) / len(labels)
    assert model.bias == pytest.approx(bias[1] - bias[0] - math.log(share / (1 - share)), abs=1e-3)


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(i, f"text {i}", lang) for i, lang in enumerate(["a"] * 40 + ["b"] * 30 + ["c"] * 20 + ["d"] * 20)]
    d = spark.createDataFrame(rows, DOCS + ", lang string")
    assert language.learn(d, most_langs=2).classes == ["a", "b"]
    assert language.learn(d.where("lang is null")).classes == ["und"]
