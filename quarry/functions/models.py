"""Models from outside, as callables: embedding (texts -> vectors) and reranking (query, texts -> scores).

`HashEmbedding` is a deterministic local stand-in. `with_backoff` repeats a call that was refused for its rate, waiting
8 s, 16 s, 32 s; any other error passes at once."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class RateLimited(RuntimeError):
    """What a client raises for a request that was refused for its rate (status 429)."""


def setting(value: str | None, name: str) -> str:
    """An explicit value, else the environment's; empty counts as none."""
    out = value or os.environ.get(name) or ""
    if not out:
        raise ValueError(f"{name} is not set")
    return out


def with_backoff(call: Callable, retries: int = 3, wait: float = 8.0, sleep: Callable = time.sleep) -> Callable:
    def run(*args, **kwargs):
        for n in range(retries + 1):
            try:
                return call(*args, **kwargs)
            except RateLimited:
                if n == retries:
                    raise
                sleep(wait * 2**n)

    return run


class HashEmbedding:
    """Unit vectors from hashes of a text's words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.split() or [""]:
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                row[int.from_bytes(h[:4], "little") % self.dim] += 1 if h[4] & 1 else -1
            if not row.any():
                row[0] = 1
            row /= np.sqrt((row**2).sum())
        return out


def dense(answer, n: int, dim: int | None = None) -> np.ndarray:
    """The vectors of a model's answer: an array, or a client's response with `data`, an object or a list of objects with
    `embedding` and perhaps `index` (then in its order). Raises ValueError if there is not one vector for each of n texts."""
    if isinstance(answer, Mapping):
        data = answer.get("data")
        data = [data] if isinstance(data, Mapping) else list(data or [])
        data = sorted(data, key=lambda d: d["index"]) if data and all("index" in d for d in data) else data
        answer = [d["embedding"] for d in data]
    out = np.asarray(answer, np.float32)
    if out.ndim != 2 or len(out) != n or (dim is not None and out.shape[1] != dim):
        raise ValueError(f"the model gave vectors of shape {out.shape} for {n} texts")
    return out


def sparse(answer) -> list[dict[int, float]]:
    """The sparse vectors of a response: for each datum its `sparse_embedding`, a list of {index, value}."""
    data = answer.get("data")
    data = [data] if isinstance(data, Mapping) else list(data or [])
    if any("sparse_embedding" not in d for d in data):
        raise ValueError("the response has no sparse vectors")
    return [{int(x["index"]): float(x["value"]) for x in d["sparse_embedding"]} for d in data]


def ranked(answer, n: int) -> list[tuple[int, float]]:
    """(position, relevance) from a reranker's answer: scores in the order of the n texts, or a response with `results` of
    {index, relevance_score}, of which there may be fewer."""
    if isinstance(answer, Mapping):
        results = answer.get("results") or (answer.get("output") or {}).get("results") or []
        out = [(int(r["index"]), float(r["relevance_score"])) for r in results]
    else:
        out = list(enumerate(np.asarray(answer, float).tolist()))
        if len(out) != n:
            raise ValueError(f"the model gave {len(out)} scores for {n} texts")
    if any(not 0 <= i < n for i, _ in out):
        raise ValueError("the model named a text that it was not given")
    return out


def embed(rows: DataFrame, model: Callable, column: str = "text", batch: int = 64) -> DataFrame:
    """Adds `embedding`, computed in batches on the executors."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        parts = [dense(model(own := list(texts[i : i + batch])), len(own)) for i in range(0, len(texts), batch)]
        return pd.Series([v.tolist() for p in parts for v in p])

    return rows.withColumn("embedding", run(F.coalesce(column, F.lit(""))))


def rerank(candidates: DataFrame, model: Callable, top_n: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, text) in the order of the model's scores, from (query_id, query, pos, chunk_id, text).

    Each query's candidates are one call, so they must be a bounded list; equal scores keep the given order."""
    kind = dict(candidates.dtypes)["query_id"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos", kind="stable")
        order = ranked(model(f["query"].iloc[0], list(f["text"])), len(f))
        f = f.iloc[[i for i, _ in order]].assign(relevance=[x for _, x in order], returned=range(len(order)))
        return f[["query_id", "chunk_id", "text", "relevance", "returned"]]

    scored = candidates.groupBy("query_id").applyInPandas(run, f"query_id {kind}, chunk_id string, text string, relevance double, returned long")
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "returned")
    out = scored.withColumn("rank", F.row_number().over(w))
    return (out if top_n is None else out.where(F.col("rank") <= top_n)).select("query_id", "rank", "chunk_id", "text")
