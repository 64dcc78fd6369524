"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector for all ordered thresholds; x marks which hashed words
and beginnings of words a text holds at all, so a text of any length is judged by what it says, not by how much of it. Training is
AdaGrad with a soft threshold (L1) on a bounded sample of labelled rows; thresholds stay ordered by being a first value
plus non-negative steps. The expected severity is the sum over k of P(grade > k). The grades are those that the labels
hold: 0 and 1 in `labels.toxic`, any 0..K in general.

Defined cases: null and empty texts have no features, so the thresholds alone speak; null labels and ids are left out of the
training and of repeated labels the largest counts; with no labelled row every severity is 0; repeated rows score alike; of
equally likely grades (ties) the lowest is given; texts of any length are taken whole; empty documents give an empty
result. Only doc_id and text are read when scoring, which maps over all documents, so further columns may carry any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as C
from quarry.llm import text_features as T

TRAIN_DOCS = 16_000
EPOCHS = 8
GAP = 0.05  # that thresholds keep between them
RATE, L1 = 0.5, 0.6  # L1: the soft threshold's pull over one epoch
PREFIXES = (4, 5, 6)  # so many first bytes of a word are features of their own


def slots(h, heads, first) -> list[np.ndarray]:
    none = np.zeros(h.size, np.int64)
    return [s for each in (h, *heads) for s in T.slots(each, none, first, (1,), ())]


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def slopes(score: float, thresholds: np.ndarray, y: int) -> tuple[float, np.ndarray]:
    """Gradient of -log P(y) by the score w.x and by each threshold."""
    k = thresholds.size
    grad = np.zeros(k)
    upper = sigmoid(thresholds[y] - score) if y < k else 1.0
    lower = sigmoid(thresholds[y - 1] - score) if y > 0 else 0.0
    p = max(upper - lower, 1e-12)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    if y < k:
        grad[y] = -du / p
    if y > 0:
        grad[y - 1] = dl / p
    return (du - dl) / p, grad


def fit(rows, grades: int, size: int = 1 << T.BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from a list of (slots, grade), each slot once."""
    w, seen = np.zeros(size), np.full(size, 1e-2)
    held, pull = np.zeros(size), RATE * L1 / max(1, len(rows))
    for at, _ in rows:
        held[at] += 1
    # a feature of many documents says little: its value is its inverse document frequency; one of a single row says nothing
    value = np.where(held > 1, np.log(max(2, len(rows)) / np.maximum(held, 1)) / np.log(max(2, len(rows))), 0.0)
    thresholds = np.linspace(0.0, 1.0, grades - 1) if grades > 2 else np.zeros(max(0, grades - 1))
    steps = np.arange(thresholds.size)
    moved, last, step = np.full(thresholds.size, 1e-2), np.zeros(size, np.int64), 0
    total, total_t = np.zeros(size), np.zeros(thresholds.size)
    for epoch in range(epochs):
        for at, y in rows:
            at = at[value[at] > 0]
            step += 1
            own, x = w[at], value[at]
            # the soft threshold of the steps that passed a weight by is made up for when it is met again
            lag = pull / np.sqrt(seen[at]) * (step - last[at])
            own = np.sign(own) * np.maximum(0, np.abs(own) - np.minimum(lag, 1e6))
            last[at] = step
            d, dt = slopes(float(own @ x), thresholds, y)
            seen[at] += (d * x) ** 2
            w[at] = own - RATE / np.sqrt(seen[at]) * d * x
            dt = np.clip(dt, -1, 1)  # two close thresholds make it as large as one likes
            moved += dt * dt
            thresholds = np.maximum.accumulate(thresholds - RATE / np.sqrt(moved) * dt - GAP * steps) + GAP * steps
        lag = pull / np.sqrt(seen) * (step - last)
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(lag, 1e6))
        last[:] = step
        if epoch * 2 >= epochs:  # the mean over the later epochs
            total += w * value
            total_t += thresholds
    n = max(1, sum(epoch * 2 >= epochs for epoch in range(epochs)))
    return total / n, total_t / n


def train(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, weights, thresholds). rows: one partition of (h, id, y, text)."""

    def run(batches):
        kept = []
        for block in C.blocks(batches):
            data, off = C.text_bytes(block.column(3))
            h, heads, first = T.tokens(data, off, PREFIXES)
            parts = slots(h, heads, first)
            for k, y in enumerate(block.column(2).to_pylist()):
                own = np.unique(np.concatenate([p[first[k] : first[k + 1]] for p in parts]))
                kept.append((own[own >= 0], max(0, y)))
        grades = max([1, *(y for _, y in kept)]) + 1
        w, thresholds = fit(kept, grades) if kept else (np.zeros(1), np.full(1, 35.0))
        at = np.flatnonzero(np.abs(w) > 1e-3)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (at.astype("<i8").tobytes(), w[at].astype("<f8").tobytes(), thresholds.astype("<f8").tobytes())], ["at", "w", "t"])

    got = rows.mapInArrow(run, "at binary, w binary, t binary").first()
    if got is None:  # no labelled row
        return np.zeros(0, np.int64), np.zeros(0), np.full(1, 35.0)
    return np.frombuffer(got["at"], "<i8"), np.frombuffer(got["w"], "<f8"), np.frombuffer(got["t"], "<f8")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, severity, grade, above): the expected grade, the likeliest one, and P(grade > k) for each threshold k."""
    at, w, thresholds = model

    def run(batches):
        table = np.zeros(1 << T.BITS, np.float32)
        table[at] = w
        for block in C.blocks(batches):
            data, off = C.text_bytes(block.column(1))
            h, heads, first = T.tokens(data, off, PREFIXES)
            total = np.zeros(block.num_rows)
            doc = np.repeat(np.arange(block.num_rows), np.diff(first))
            for part in slots(h, heads, first):
                hit = np.flatnonzero((part >= 0) & (table[part] != 0))
                once = np.unique(doc[hit] * (1 << T.BITS) + part[hit])
                total += np.bincount(once >> T.BITS, table[once & ((1 << T.BITS) - 1)], block.num_rows)
            at_most = sigmoid(thresholds[None, :] - total[:, None])
            p = np.diff(np.concatenate((np.zeros((total.size, 1)), at_most, np.ones((total.size, 1))), axis=1), axis=1)
            above = pa.ListArray.from_arrays(pa.array(np.arange(total.size + 1, dtype=np.int32) * thresholds.size), pa.array(np.round(1 - at_most, 9).reshape(-1)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.round((1 - at_most).sum(axis=1), 9)), pa.array(p.argmax(axis=1).astype(np.int32)), above], ["doc_id", "severity", "grade", "above"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int, above array<double>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0: not learnt from), severity, grade, toxic (grade above 0), above (P(grade > k) for each threshold k)."""
    docs = C.table(spark, sf_dir, "documents")
    held = lambda c: C.held_out(c, 5, 0)
    model = train(T.labelled(docs, C.table(spark, sf_dir, "labels"), "toxic", held, TRAIN_DOCS))
    return score(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "severity", "grade", (F.col("grade") > 0).alias("toxic"), "above")
