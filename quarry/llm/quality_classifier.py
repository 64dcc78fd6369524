"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

The features of a text are the shares of its n-grams (words 1-2, token shapes 1-3); a score is the sparse dot product
with the weights, through the logistic function. Training is one task over a bounded sample of labelled rows (TRAIN_DOCS,
drawn by hash of the id), with per-coordinate FTRL-proximal updates; scoring maps over all documents without a shuffle.

Defined cases: null and empty texts get the score of the bias alone; unlabelled ids are scored like others; null labels
and ids are left out of the training and of repeated labels (ties) the largest counts; with no labelled row at all the score is
0.5; repeated rows score alike; texts of any length are taken whole; empty documents give an empty result. Only doc_id and
text are read when scoring, so further columns may carry any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as C
from quarry.llm import text_features as T

TRAIN_DOCS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
WORDS, SHAPES = (1, 2), (1, 2, 3)
GAIN = 4.0  # shares are multiplied by this
THRESHOLD = 0.3


class Ftrl:
    """FTRL-proximal for sparse rows; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def rows_of(col: pa.Array):
    """(slots, values) of every document of a block: shares of n-grams per order."""
    data, off = C.text_bytes(col)
    h, shape, first = T.tokens(data, off)
    parts = list(T.slots(h, shape, first, WORDS, SHAPES))
    for k in range(len(col)):
        a, b = first[k], first[k + 1]
        at, x = [], []
        for part in parts:
            own = part[a:b]
            own = own[own >= 0]
            s, c = np.unique(own, return_counts=True)
            at.append(s)
            x.append(c * (GAIN / max(1, b - a)))
        s, inverse = np.unique(np.concatenate(at), return_inverse=True)
        yield s, np.bincount(inverse, np.concatenate(x), s.size) if s.size else np.zeros(0)


def train(rows: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of the non-zero weights. rows: one partition of (h, id, y, text)."""

    def run(batches):
        model, kept = Ftrl(1 << T.BITS), []
        for block in C.blocks(batches):
            kept += [(np.append(s, 1 << T.BITS), np.append(x, 1.0).astype(np.float32), y) for (s, x), y in zip(rows_of(block.column(3)), block.column(2).to_pylist(), strict=True)]
        for _ in range(epochs):
            for s, x, y in kept:
                model.update(s, x.astype(np.float64), float(y > 0))
        w = model.weights()
        at = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([w[at].astype("<f8").tobytes()], pa.binary()), pa.array([float(w[-1])])], ["at", "w", "bias"])

    got = rows.mapInArrow(run, "at binary, w binary, bias double").first()
    if got is None:  # no labelled row
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(got["at"], "<i8"), np.frombuffer(got["w"], "<f8"), got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every document."""
    at, w, bias = model

    def run(batches):
        table = np.zeros(1 << T.BITS, np.float32)
        table[at] = w
        for block in C.blocks(batches):
            data, off = C.text_bytes(block.column(1))
            h, shape, first = T.tokens(data, off)
            each = np.zeros(h.size + 1)
            for part in T.slots(h, shape, first, WORDS, SHAPES):
                each[1:] += np.where(part >= 0, table[part], 0)
            total = np.cumsum(each)
            logit = (total[first[1:]] - total[first[:-1]]) * GAIN / np.maximum(1, np.diff(first)) + bias
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.round(1 / (1 + np.exp(-np.clip(logit, -35, 35))), 9))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held = lambda c: C.held_out(c, 5, 0)
    model = train(T.labelled(docs, C.table(spark, sf_dir, "labels"), "quality", held, TRAIN_DOCS))
    return score(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
