"""Quality classifier: supervised subword embeddings, trained by numpy SGD.

A document is the average of learned vectors of its hashed features: words,
pairs of words, and character n-grams. A softmax layer gives the
class probabilities. Since the average and the layer are both linear, scoring
folds the layer into the table and adds up one number a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bytetext import NOT_SPACE, SpanHash, give_back, mix, slices, spans
from ledgerloom.llm.scratch import batches_of, fresh, stored

NGRAMS = (3, 4)
BUCKET_BITS = 18
#: All pairs of a word with itself share this one feature, so that it is learned from few rows. Of the teaching rows of sf0.1, those
#: with remainder 1 (795) judge a model of the others (1826): 0.9987 of them are right with the feature, 0.9711 without.
_REPEAT = np.uint64(0x5EED)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features: bucket of each, and for each row the border of its features."""
    if not len(data):
        return
    down, hashed = np.uint64(64 - BUCKET_BITS), SpanHash(data)
    begin, end, rows = spans(NOT_SPACE[data], offsets)
    if len(begin):
        words = hashed(begin, end)
        yield (words >> down).astype(np.int32), np.stack((rows[:-1], rows[1:]))
        pairs = mix(words[:-1] * np.uint64(3) + words[1:] + np.uint64(1))
        pairs[words[:-1] == words[1:]] = mix(_REPEAT[None])[0]
        # rows without words after the last word begin where no pair is
        yield (pairs >> down).astype(np.int32), np.minimum(np.stack((rows[:-1], np.maximum(rows[1:] - 1, rows[:-1]))), len(pairs))
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
    rows = np.searchsorted(starts, offsets)
    for n in NGRAMS:
        count = len(starts) - n
        if count <= 0:
            continue
        keys = hashed(starts[:count], starts[n:]) ^ (np.uint64(n) << np.uint64(60))  # a word of n characters is another feature
        last = np.maximum(rows[1:] - n + 1, rows[:-1])
        yield (keys >> down).astype(np.int32), np.stack((np.minimum(rows[:-1], count), np.minimum(last, count)))


@dataclass
class Model:
    weights: np.ndarray  #: of each bucket: how much it adds to the log odds of label 1, before averaging
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of a slice."""
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for buckets, (low, high) in features(data, offsets):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[buckets], dtype=np.float64)))
            total += sums[high] - sums[low]
            count += high - low
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(texts: list[str], labels: list[int], prior: float, *, dim: int = 8, epochs: int = 12, rate: float = 0.6, seed: int = 7) -> Model:
    """Fits on a bounded sample; prior: the share of label 1 among all labelled rows."""
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for _, _, data, offsets in slices(pa.array(texts, pa.string())):
        parts = list(features(data, offsets))
        for i in range(len(offsets) - 1):
            own = [buckets[low[i] : high[i]] for buckets, (low, high) in parts]
            buckets, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.int32), return_counts=True)
            rows.append((buckets, (n / max(1, n.sum())).astype(np.float32)))
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            buckets, share = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ table[buckets] if len(buckets) else np.zeros(dim, np.float32)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            if len(buckets):
                # the mean's gradient is shared out; scaled up, since each feature moves the mean by its share only
                table[buckets] -= (step * 20) * np.outer(share, back)
    shift = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(max(np.mean(labels), 1e-6) / max(1 - np.mean(labels), 1e-6)) if len(labels) else 0.0
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift))


def affordable(sizes: list[tuple], most_rows: int, most_bytes: int) -> list:
    """Of (id, rows, bytes) the ids that fit into the bounds, in turn; one that does not fit is passed over."""
    kept, rows, held = [], 0, 0
    for name, n, size in sizes:
        if rows + n <= most_rows and held + size <= most_bytes:
            kept.append(name)
            rows, held = rows + n, held + size
    return kept


def whole_texts(picked: DataFrame, most_rows: int, most_bytes: int) -> pa.Table:
    """Rows of picked (doc_id, text and others) by hash of doc_id, each with its whole text, within the bounds.

    The ids and sizes that come to the driver are those of picked, which has a bounded number of ids.
    """
    sizes = picked.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    ids = affordable([tuple(r) for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect()], most_rows, most_bytes)
    return picked.where(F.col("doc_id").isin(ids)).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()


def learn(documents: DataFrame, labels: DataFrame, *, label: str = "quality", most_rows: int = 3000, most_bytes: int = 32_000_000) -> Model:
    """A model of `label` from at most `most_rows` labelled documents, half of each class.

    Only rows whose crc32 of the doc_id as text is not divisible by 5 teach. The
    sample takes the smallest hashes of doc_id, so it is the same for any layout;
    whole texts teach, `most_bytes` in all: a document that no longer fits is
    passed over. Null labels and null ids teach nothing. Without both classes among the
    labels the score is the share of label 1, or 0.5 without any.
    """
    held = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(f"label in (0, 1) and doc_id is not null").where(~held_out("doc_id", 5, 0))
    counts = {r[0]: r[1] for r in held.groupBy("label").count().collect()}
    prior = (counts.get(1, 0) / sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.clip(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)), -20, 20)))
    picked = [held.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows // 2) for x in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = whole_texts(texts.join(F.broadcast(ids), "doc_id"), 2 * most_rows, most_bytes)  # broadcast: at most most_rows ids
    model = train(sample["text"].to_pylist(), sample["label"].to_pylist(), prior)
    give_back()
    return model


def held_out(column: str, folds: int, fold: int):
    """Whether crc32 of an id as text has that remainder; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _score(model: Model):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.scores(data, offsets) for _, _, data, offsets in slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def scored(documents: DataFrame, model: Model, *, out: str = "quality_score") -> DataFrame:
    """documents with the probability of label 1 of each whole text.

    Null and empty texts have no features and get the bias alone. Rows keep
    their number and their other columns.
    """
    return documents.withColumn(fresh(documents.columns, out), _score(model)(F.col("text")))


def good(documents: DataFrame, labels: DataFrame, *, least: float = 0.3, **options) -> DataFrame:
    """The documents that score at least `least`, with their own columns; written to the shared folder."""
    done = scored(documents, learn(documents, labels, **options))
    with batches_of(documents.sparkSession, 1000):
        return stored(done.where(F.col(f"`{done.columns[-1]}`") >= least).select(*[F.col(f"`{c}`") for c in documents.columns]), "good")
