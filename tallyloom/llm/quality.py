"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to vectors; a document is the mean of its features' vectors, a softmax layer over
it gives the classes, and both are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows (FIT_ROWS, those of least id hash). A trained model is linear in a document's features, so scoring needs
one number a feature and class: texts are scored where they are read, in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table, trimmed

BITS = 17
DIM = 8
NGRAMS = (2, 3, 4)
EPOCHS = 5
RATE = 0.4
#: At most this many labelled rows are fitted on.
FIT_ROWS = 6000
THRESHOLD = 0.3
FOLDS = 5

_SPACE = np.zeros(0x3001, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_POWERS = np.array([pow(0x9E3779B1, k + 1, 2**32) | 1 for k in range(64)], np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BITS)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words and each n-gram length: hashed features of all texts in order, and where each text's begin (one more at the end).

    Texts are joined by a zero, which counts as space; n-grams that touch it are left out.
    """
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = _SPACE[np.minimum(points, 0x3000)]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(begins):
        inside = np.arange(len(points)) - np.repeat(begins, np.diff(np.append(begins, len(points))))[-len(points) + begins[0] :] if begins[0] == 0 else None
        if inside is None:
            inside = np.zeros(len(points), np.int64)
            inside[begins[0] :] = np.arange(len(points) - begins[0]) - np.repeat(begins - begins[0], np.diff(np.append(begins, len(points))))
        values = np.where(space, np.uint32(0), (points + np.uint32(1)) * _POWERS[inside & 63] + (inside >> 6).astype(np.uint32))
        hashed = np.add.reduceat(values, begins, dtype=np.uint32)
        yield _mix(hashed ^ np.uint32(0x5BD1E995)), np.searchsorted(begins, starts)
    else:
        yield np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
    for n in NGRAMS:
        size = max(0, len(points) - n + 1)
        h, whole = np.full(size, n * 0x27D4EB2F, np.uint32), np.ones(size, bool)
        for k in range(n):
            part = points[k : k + size]
            h = h * np.uint32(0x01000193) ^ part
            h ^= h >> np.uint32(16)
            whole &= part != 0
        kept = np.concatenate([[0], np.cumsum(whole)])
        yield _mix(h[whole]), kept[np.minimum(starts, size)]


class SubwordClassifier:
    """vectors: hashed feature -> DIM numbers; out: classes x DIM; bias: classes."""

    def __init__(self, classes: int = 2, seed: int = 7):
        self.vectors = (np.random.default_rng(seed).random((1 << BITS, DIM), np.float32) - np.float32(0.5)) / DIM
        self.out, self.bias, self.seed = np.zeros((classes, DIM), np.float32), np.zeros(classes, np.float32), seed

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> SubwordClassifier:
        rows = []
        for t in texts:
            ids = np.concatenate([f for f, _ in features([t])])
            ids, counts = np.unique(ids, return_counts=True)
            rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
        order, step, steps = np.random.default_rng(self.seed), 0, max(1, epochs * len(rows))
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                ids, share = rows[i]
                lr, step = np.float32(rate * (1 - step / steps)), step + 1
                mean = share @ self.vectors[ids]
                z = self.out @ mean + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = p @ self.out
                self.out -= lr * np.outer(p, mean)
                self.bias -= lr * np.float32(0.1) * p
                # a document's features share one gradient; its length must not make their step vanish
                self.vectors[ids] -= (lr * np.float32(len(ids)) ** np.float32(0.5)) * share[:, None] * back[None, :]
        return self

    def linear(self) -> tuple[np.ndarray, float]:
        """Of two classes: what each feature adds to the log odds of class 1, and the constant."""
        return (self.vectors @ (self.out[1] - self.out[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def probabilities(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, at in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(weights[ids], dtype=np.float64)])
        total += sums[at[1:]] - sums[at[:-1]]
        count += np.diff(at)
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """The model of two classes, fitted on the `rows` labelled, not held-out rows of least id hash. Without any, it says 0.5 of all.

    Of several texts of one id the least is taken, so every fit is the same.
    """
    some = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg(F.max(label).alias("label"))
    some = some.orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    found = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), doc_id).groupBy(doc_id).agg(F.min("text").alias("text"), F.first("label").alias("label")).toPandas()
    if found.empty:
        return np.zeros(1 << BITS, np.float32), 0.0
    found = found.sort_values(doc_id)
    model = SubwordClassifier().fit(found["text"].tolist(), found["label"].astype(int).tolist()).linear()
    del found
    give_back()
    return model


def scored(docs: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with their score: the probability of label 1, from the text alone. Null and empty texts get the model's constant."""
    kept = [c for c in docs.columns if c != score]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{score}` double"])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                some = batch.slice(k, 128)
                out = probabilities([t or "" for t in some.column(at).to_pylist()], weights, bias)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out)], [*kept, score])

    return docs.mapInArrow(trimmed(run), schema)


def accepted(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold."""
    columns, score = docs.columns, "quality_score"
    while score in columns:
        score += "_"
    out = scored(docs, fit(docs, labels, text=text, doc_id=doc_id, label=label), text=text, score=score)
    return out.filter(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
