"""Chunk-level operators: small-chunk merge, identity, deduplication and provenance."""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import paths


def merge_small(chunks: DataFrame, min_token: int, corpus: str = "corpus_id", order: str = "seq") -> DataFrame:
    """Chunks of under min_token tokens join the one before; leading ones join the first large one.

    chunks: (corpus, order, tokens, segments). A corpus of small chunks alone becomes one chunk, or nothing if it held
    one. The group of a chunk is the number of large chunks up to it, one at least: a running sum in two passes, per
    source file where there is a `part` column, so that one corpus is no single window at scale."""
    large = (F.col("tokens") >= min_token).cast("long")
    if "part" in chunks.columns:
        sizes = chunks.groupBy(corpus, "part").agg(F.sum(large).alias("n"))
        before = Window.partitionBy(corpus).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(corpus, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        own = Window.partitionBy(corpus, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = chunks.join(offsets, [corpus, "part"]).withColumn("g", F.greatest(F.lit(1), F.sum(large).over(own) + F.col("offset")))
        key = F.struct("part", order)
    else:
        own = Window.partitionBy(corpus).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = chunks.withColumn("g", F.greatest(F.lit(1), F.sum(large).over(own)))
        key = F.struct(order)
    merged = rows.groupBy(corpus, "g").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("n"), F.sum(large).alias("n_large"), F.sort_array(F.collect_list(F.struct(key.alias("key"), "segments"))).alias("parts"))
    kept = merged.where("n > 1 or n_large > 0")
    return kept.select(corpus, F.col("g").cast("long").alias("seq"), "tokens", F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"))


def blake2b(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def blake2b_128(text: Column) -> Column:
    """The 128-bit hash as a column; Spark has none of its own, so it runs in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else blake2b(t))

    return run(text)


def identify(chunks: DataFrame, hash_fn=blake2b_128) -> DataFrame:
    """Adds content_hash (of the segments' texts) and chunk_id (of the sorted paths and the content hash).

    hash_fn: Column -> Column; any hash can take the place of the 128-bit default."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n")
    hashed = chunks.withColumn("content_hash", hash_fn(text))
    key = F.concat(F.array_join(F.array_sort(paths(F.col("segments"))), "\x00"), F.lit("\x01"), F.col("content_hash"))
    return hashed.withColumn("chunk_id", hash_fn(key))


def keep_first(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Of the rows of each key the first in the given order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def provenance(segments: DataFrame) -> DataFrame:
    """(chunk_id, path, start_line, end_line): the least and greatest line per path, from (chunk_id, path, lines)."""
    return segments.groupBy("chunk_id", "path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def sources(segments: Column) -> Column:
    """The same within one chunk, as an array of (path, start_line, end_line) in the order in which paths first appear."""
    of = lambda p: F.filter(segments, lambda s: s["file_path"] == p)
    return F.transform(
        paths(segments),
        lambda p: F.struct(p.alias("path"), F.array_min(F.transform(of(p), lambda s: s["start_line"])).alias("start_line"), F.array_max(F.transform(of(p), lambda s: s["end_line"])).alias("end_line")),
    )


def merging(min_token: int, **columns):
    """Decorator: a function that returns chunks returns them merged."""

    def put(make):
        @functools.wraps(make)
        def run(*args, **kwargs) -> DataFrame:
            return merge_small(make(*args, **kwargs), min_token, **columns)

        return run

    return put
