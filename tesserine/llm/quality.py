"""Quality classification by supervised subword embeddings.

A document is the average of learned vectors, one for each of its words, word
pairs and character n-grams, hashed into ``BUCKETS`` rows; a softmax over a linear layer
turns it into two probabilities. Both layers are trained together by plain
stochastic gradient descent in numpy. Because the output is linear in the
average, a trained model scores a text by averaging one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash, rows, small_batches, stored, utf8

#: Rows of the embedding table, its width, byte lengths of character n-grams, most training documents, and most bytes of their texts.
BUCKETS, WIDTH, NGRAMS, FIT, FIT_BYTES = 1 << 17, 8, (3, 4), 4000, 128 << 20
EPOCHS, RATE, SEED = 12, 0.5, 11
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    return ((x * _PRIME) >> np.uint64(64 - 17)).astype(np.int64)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words and character n-grams of a UTF-8 text, with their counts."""
    raw = np.frombuffer(b" " + text + b" ", dtype=np.uint8)
    gap = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    raw = np.where(gap, 0x20, raw).astype(np.uint64)
    keep = np.r_[True, ~(gap[1:] & gap[:-1])]  # white space counts as one gap
    raw, gap = raw[keep], gap[keep]
    out = []
    for n in NGRAMS:
        if len(raw) >= n:
            value = np.full(len(raw) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                value = (value << np.uint64(8)) | raw[i : len(raw) - n + 1 + i]
            out.append(_spread(value))
    edge = np.flatnonzero(gap)
    if len(edge) > 1:
        # A word's hash: the difference of running sums of hashed (byte, place in word) pairs.
        place = np.arange(len(raw)) - np.repeat(edge, np.diff(np.r_[edge, len(raw)]))
        mixed = (raw + np.uint64(256) * place.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        total = np.cumsum(mixed, dtype=np.uint64)
        word = total[edge[1:] - 1] - total[edge[:-1]]
        out.append(_spread(word ^ np.uint64(0x5851F42D4C957F2D)))
        # Word pairs by the xor of their hashes, so that a word next to itself is one feature for all words.
        out += [_spread((word[lag:] ^ word[:-lag]) + np.uint64(lag)) for lag in (1, 2) if len(word) > lag]
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    every = np.concatenate(out)
    every.sort()
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[first], np.diff(np.r_[first, len(every)])


class Model:
    """Per-bucket evidence for label 1 (the logit difference that its vector adds) and a bias."""

    def __init__(self, evidence: np.ndarray, bias: float):
        self.evidence, self.bias = evidence, bias

    def score(self, text: bytes) -> float:
        at, n = features(text)
        logit = self.bias + (float(self.evidence[at] @ n) / float(n.sum()) if len(at) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500))))


def train(sample: list[tuple[bytes, int]], *, epochs: int = EPOCHS, rate: float = RATE, width: int = WIDTH, seed: int = SEED) -> Model:
    """Stochastic gradient descent over (text, label) rows, in an order that the seed fixes."""
    table = np.random.default_rng(seed).uniform(-1.0 / width, 1.0 / width, (BUCKETS, width))
    out, bias = np.zeros((width, 2)), np.zeros(2)
    rng = np.random.default_rng(seed + 1)
    rows_ = [(at.astype(np.int32), n.astype(np.float32), int(label == 1)) for (at, n), label in ((features(text), label) for text, label in sample)]
    rows_ = [r for r in rows_ if len(r[0])]
    labels = np.array([r[2] for r in rows_])
    if not len(labels):
        return Model(np.zeros(BUCKETS), 0.0)
    if labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), 4.0 if labels[0] else -4.0)
    # Both labels weigh alike in half of each step, so that the rarer one is learned as well.
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = 0.5 + 0.25 / share
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(rows_)):
            at, n, label = rows_[k]
            part = n / n.sum()
            hidden = part @ table[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= step * weight[label]
            back = out @ p
            out -= np.outer(hidden, p)
            bias -= p
            # Scaled by the number of features, as each has only its small share of the average.
            table[at] -= np.outer(part * min(len(at), 50), back)
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str, text_col: str, label_col: str, fit: int, fit_bytes: int = FIT_BYTES) -> list[tuple[bytes, int]]:
    """At most ``fit`` labelled rows of ``train``, chosen by hash of the id, in order of that hash, until their texts have ``fit_bytes``."""
    known = labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(fit)
    chosen = stored(chosen, "fit")
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text")).join(chosen, "_id")
    taken, size = [], 0
    for r in found.orderBy(F.xxhash64("_id"), "_id", "_text").limit(fit).toLocalIterator():
        taken.append((bytes(r["_text"]), r["_label"]))
        size += len(r["_text"])
        if size >= fit_bytes:
            break
    return taken


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = FIT) -> Model:
    return train(training_rows(docs, labels, train_rows, id_col=id_col, text_col=text_col, label_col=label_col, fit=most))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", at: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of each row; null text counts as empty and gets the bias alone."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus
    shape = source.select("doc_id", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [shared.value.score(x) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, shape).withColumn("predicted", (F.col("score") >= at).cast("int"))


def classify_held_out(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, out: int = 1, at: float = 0.5) -> DataFrame:
    """Fit on labelled rows whose crc32 of the id isn't ``out`` modulo ``folds``; doc_id, held_out, score, predicted of all rows.

    An id with several labels counts as 1 if any is. Without labelled rows, every
    score is 1/2; with one label only, all scores lean to it. Null and empty texts get
    the bias alone. A score of just ``at`` counts as 1. Repeated rows are each scored. Very long texts are read whole. An empty table gives
    no rows. Other columns, whatever their names, have no effect.
    """
    held = F.pmod(id_hash(F.col(id_col)), F.lit(folds)) == out
    model = fit(docs, labels, ~held, id_col=id_col, text_col=text_col, label_col=label_col)
    scored = score(docs, model, id_col=id_col, text_col=text_col, at=at)
    return scored.select("doc_id", (F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) == out).alias("held_out"), "score", "predicted")
