"""FTRL-proximal logistic regression over hashed features, fitted on a bounded sample and sent out as sparse weights."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import mix64, texts

BITS = 20
#: At most so many labelled rows are fitted on, those whose ids hash lowest.
MAX_ROWS = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 15.0, 0.05, 8

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_features(words: list[bytes], alone: tuple[bytes, ...] = ()) -> np.ndarray:
    """Distinct hashed features of the words: single words, pairs of neighbours, and pairs with a word between; and of
    each of `alone`, which has no neighbours."""
    if not words and not alone:
        return np.zeros(0, dtype=np.int64)
    every = mix64(np.fromiter(map(zlib.crc32, [*words, *alone]), dtype=np.uint64, count=len(words) + len(alone)) + _A)
    h = every[:len(words)]
    with np.errstate(over="ignore"):
        grams = np.concatenate([every, mix64(h[:-1] * _A + h[1:] * _B), mix64(h[:-2] * _A + h[2:] * _C)])
    return np.unique((grams >> np.uint64(64 - BITS)).astype(np.int64))


class Ftrl:
    """Per-coordinate FTRL-proximal; z and n are kept for each feature, the weights follow from them."""

    def __init__(self, size: int = 1 << BITS):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)
        self.l1 = np.full(size + 1, L1)
        self.l1[size] = 0.0  # the last feature is the intercept

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(rows: DataFrame, labels: list[str], features: Callable[[bytes], np.ndarray], epochs: int = EPOCHS) -> list[dict[int, float]]:
    """One weight table for each value of `labels` against the rest.

    rows: (h, text, label), at most a few times MAX_ROWS of them; one task learns from them in the order of h, text.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            for t, y in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                seen.append((np.append(features(t), 1 << BITS).astype(np.int32), y))
        for k, label in enumerate(labels if seen else []):
            model = Ftrl()
            for _ in range(epochs):
                for at, y in seen:
                    model.learn(at, float(y == label))
            at = np.arange(len(model.z))
            w = model.weights(at)
            at = at[w != 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(w[at])],
                                             names=["k", "at", "w"])

    one = rows.repartition(1).sortWithinPartitions("h", "text").select("text", "label")
    tables: list[dict[int, float]] = [{} for _ in labels]
    for r in one.mapInArrow(learn, "k int, at long, w double").collect():  # at most len(labels) * 2 ** BITS small rows
        tables[r["k"]][r["at"]] = r["w"]
    return tables


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(h, text, label) of the `max_rows` labelled ids that hash lowest. labels: (doc_id, label), an id once."""
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
           .select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_rows))
    # max_rows ids: a bounded broadcast; an id that stands in several documents counts by its smallest text
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text"))


class Weights:
    """A weight table as arrays: the sum of the weights of features."""

    def __init__(self, table: dict[int, float]):
        self.bias = table.get(1 << BITS, 0.0)
        self.dense = np.zeros(1 << BITS, dtype=np.float32)
        for k, w in table.items():
            if k < 1 << BITS:
                self.dense[k] = w

    def score(self, at: np.ndarray) -> float:
        return sigmoid(self.bias + float(self.dense[at].sum(dtype=np.float64)))
