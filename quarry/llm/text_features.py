"""Hashed word n-gram features of whole texts, vectorised over a block of documents.

Tokens are runs of letters, digits and non-ASCII bytes (hashed in lower case) and every other visible byte on its own.
A second stream keeps the shape of each token (lower, capital, upper, digit or the symbol itself, and whether it repeats
the token before), so that n-grams over shapes carry to unseen words. A feature is a slot of a table of 2**BITS weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common as C

BITS = 20
_U = np.uint64
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_SPACE = np.array([b <= 0x20 or b == 0x7F for b in range(256)])
_IS_UP = np.array([0x41 <= b <= 0x5A for b in range(256)])
_IS_LOW = np.array([0x61 <= b <= 0x7A for b in range(256)])


def tokens(data: np.ndarray, off: np.ndarray, prefix: tuple[int, ...] = ()):
    """(token hashes, shape codes, first token of each document and the end); with prefix, hashes of the tokens' first
    bytes, one array for each number of bytes, in place of the shapes."""
    lower = C.LOWER[data]
    ws, we = C.word_bounds(lower, off, _WORD)
    sym = np.flatnonzero(~_WORD[data] & ~_SPACE[data])
    starts, ends = np.concatenate((ws, sym)), np.concatenate((we, sym + 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    h = C.span_hashes(lower, starts, ends)
    first = np.searchsorted(starts, off)
    if prefix:
        return h, [C.mix(C.span_hashes(lower, starts, np.minimum(ends, starts + n)) + _U(n)) for n in prefix], first
    if not starts.size:
        return h, np.zeros(0, np.int64), first
    up = np.concatenate(([0], np.cumsum(_IS_UP[data], dtype=np.int32)))
    low = np.concatenate(([0], np.cumsum(_IS_LOW[data], dtype=np.int32)))
    n_up, n_low, head = up[ends] - up[starts], low[ends] - low[starts], data[starts]
    shape = np.where(_WORD[head], np.where((n_up > 0) & (n_low == 0) & (ends - starts > 1), 2, np.where(_IS_UP[head], 1, np.where((head >= 0x30) & (head <= 0x39), 3, 0))), 4 + head.astype(np.int64))
    same = np.zeros(h.size, bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < h.size]] = False
    return h, shape + 512 * same, first


def slots(h: np.ndarray, shape: np.ndarray, first: np.ndarray, words: tuple[int, ...], shapes: tuple[int, ...], bits: int = BITS):
    """One array of slots per n-gram order; an n-gram that crosses documents has slot -1."""
    n = h.size
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # tokens up to the end of the document
    mixed = C.mix(shape.astype(_U) + _U(0x51ED27))
    for salt, base, orders in ((1, h, words), (2, mixed, shapes)):
        for k in orders:
            g = C.ngram_hashes(base, k)
            out = np.full(n, -1, np.int64)
            out[: g.size] = (C.mix(g + _U(salt * 1000 + k)) >> _U(64 - bits)).astype(np.int64)
            out[left < k] = -1
            yield out


def labelled(docs: DataFrame, labels: DataFrame, column: str, held, max_docs: int):
    """Training rows (text, y) of labelled documents outside `held`, at most about max_docs of them, in one partition.

    The sample is those ids whose hash falls below the share that max_docs allows; ids are few enough to be broadcast.
    Null labels, ids and documents without a label are left out; of repeated labels the largest counts."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(column).cast("int").alias("y"))
    ids = ids.where(~held(F.col("id"))).withColumn("h", F.xxhash64("id"))
    total = ids.count()
    share = min(1.0, 0.9 * max_docs / max(1, total))
    ids = ids.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id")
    return rows.select("h", "id", "y", F.coalesce("text", F.lit("")).alias("text")).repartition(1).sortWithinPartitions("h", "id", "text")
