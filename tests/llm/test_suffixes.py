"""Removal of repeated strings against counting all of them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import suffixes

DOCS = "doc_id bigint, text string"


def windows(raws, length):
    seen = Counter(t[i : i + length] for t in raws for i in range(len(t) - length + 1))
    return [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in raws]


def brute(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    out = []
    for (i, _), t, again in zip(docs, raws, windows(raws, length)):
        gone = np.zeros(len(t) + 2, bool)
        for p in np.flatnonzero(again):
            gone[p + 1 : p + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((i or 0, len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone[1:]) if not g)))
    return sorted(out)


def test_expansion_finds_every_repeated_window():
    r = random.Random(1)
    for trial in range(200):
        length = r.randrange(1, 9)
        letters = b"ab" if trial % 2 else bytes(range(256)) if trial % 5 == 0 else b"abc\0"
        texts = [bytes(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(r.randrange(1, 8))]
        texts[-1] = texts[0][3:20] + texts[-1]
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        marks = np.zeros(len(data), bool)
        marks[ends] = True
        got = suffixes.repeated(data, marks, length)
        for t, end, want in zip(texts, ends, windows(texts, length)):
            assert got[end - len(t) : max(end - length + 1, end - len(t))].tolist() == want


def passages(seed):
    """Texts that share passages in other surroundings, with nulls, short texts, runs, copies and characters of many bytes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé日") for _ in range(r.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(3)]
    docs = [(i, text(r.randrange(40)) + r.choice(shared)[r.randrange(20) : r.randrange(40, 90)] + text(r.randrange(30))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 200), (None, docs[3][1]), (3, docs[3][1]), (104, docs[5][1]), (105, "short"), (106, text(2000)), (107, docs[0][1][:50] * 2), (108, "hjklmno" * 9), (109, "qwertzuiopy" * 12), (None, None)]
    return docs


@pytest.mark.parametrize(("length", "block"), [(24, 1 << 20), (24, 100), (40, 300), (1, 50)])
def test_removal_matches_brute_force(spark, length, block):
    """Small blocks split the shared passages' anchors by longer grams."""
    docs = passages(length + block)
    table = spark.createDataFrame(docs, DOCS).withColumns({"k1": F.lit(1), "suffix_dedup": F.lit("x"), "cuts": F.lit(2)}).repartition(5)
    done = suffixes.without_repeats(table, length=length, block=block)
    assert done.columns[:5] == table.columns
    got = sorted((x[0] or 0, x[-1].n_bytes, x[-1].n_removed, x[-1].n_spans, bytes(x[-1].kept)) for x in done.collect())
    assert got == brute(docs, length)


def test_texts_without_repeats(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
    (row,) = suffixes.without_repeats(spark.createDataFrame([(1, "x" * 10 + "y" * 10)], DOCS), length=11).collect()
    assert row.suffix_dedup.n_removed == 0 and bytes(row.suffix_dedup.kept) == b"x" * 10 + b"y" * 10


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    """A task's parts of a text overlap, so no window is lost between them."""
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    r = random.Random(9)
    raws = ["".join(r.choice("ab") for _ in range(700)).encode() for _ in range(3)]
    raws.append(raws[0][50:600] + raws[1][100:300])
    starts = Counter()
    for t in raws:
        offsets = np.array([0, len(t)])
        allowed = suffixes._allowed(offsets, None, 20)
        for base in range(0, len(allowed), suffixes.CHUNK):
            first, last, _ = suffixes.runs(np.frombuffer(t, np.uint8)[base : base + suffixes.CHUNK + 19], allowed[base : base + suffixes.CHUNK], 6, 20)
            for a, b in zip(first + base, last + base):
                starts.update(range(a, b + 1))
    assert starts == Counter(i for t in raws for i in range(len(t) - 19))
