"""Index build: files -> chunks -> merge -> embedding -> three tables in one commit; invalidation by source path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import models
from quarry.functions.text import render
from quarry.operators import chunks, markdown
from quarry.sources import files
from quarry.sources.store import Store
from quarry.sources.tables import BM25Table, ChunkSchema, ChunkTable, VectorSchema, VectorTable


@dataclass(frozen=True)
class Strategy:
    max_token: int = 1024
    min_token: int = 30
    vector: VectorSchema | None = None
    bm25: str | None = None
    tokenizer: str = "unicode_word"
    chunk: ChunkSchema = field(default_factory=ChunkSchema)

    def __post_init__(self):
        if self.vector is None and self.bm25 is None:
            raise ValueError("at least one of vector and bm25 is needed")


def _called(fields_of: Callable[[dict], dict], declared: list[str]):
    """fields_of as a column function from chunks to maps; a declared field that it leaves out raises KeyError."""

    @F.pandas_udf("map<string,string>")
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.to_dict("records"):
            given = fields_of(row)
            out.append({f: given[f] for f in declared})
        return pd.Series(out)

    return run


class Pipeline:
    def __init__(self, store: Store, strategy: Strategy, model: Callable | None = None):
        if strategy.vector is not None and model is None:
            raise ValueError("vectors need an embedding model")
        self.store, self.strategy, self.model = store, strategy, model
        self.chunks = ChunkTable(store)
        self.vectors = VectorTable(store) if strategy.vector else None
        self.bm25 = BM25Table(store, strategy.tokenizer, strategy.bm25) if strategy.bm25 else None
        with store.transaction():
            self.chunks.create_table(strategy.chunk)
            if self.vectors:
                self.vectors.create_table(strategy.vector)
            if self.bm25:
                self.bm25.open()

    def chunking(self, folders: list[str]) -> DataFrame:
        """Drafts (corpus_id, part, seq, tokens, segments) of all Markdown files below the folders."""
        found = files.markdown(self.store.spark, folders)
        found = found.select(F.format_string("%05d/%s", "folder_idx", "path").alias("part"), "path", "text")
        return markdown.chunk(found, self.strategy.max_token, key="part", path="path").select(F.lit(0).alias("corpus_id"), "part", "seq", "tokens", "segments")

    def merge(self, drafts: DataFrame) -> DataFrame:
        return chunks.merge_small(drafts, self.strategy.min_token)

    def embedding(self, drafts: DataFrame) -> DataFrame:
        return models.embed(markdown.rendered(drafts), self.model, "text_with_summary").drop("text_with_summary")

    def store_chunks(self, merged: DataFrame, fields_of: dict[str, Column] | Callable[[dict], dict] | None = None) -> None:
        """Writes all tables in one commit. Of equal chunk ids the first stays. fields_of: a column for each declared
        field, or a function from a chunk (a dict) to a dict of texts, run in batches; None stands for nulls in all."""
        declared = sorted({*self.strategy.chunk.fields, *(self.strategy.vector.fields if self.vectors else ())})
        if isinstance(fields_of, dict) and not set(declared) <= set(fields_of):
            raise KeyError(f"fields_of lacks {sorted(set(declared) - set(fields_of))}")
        rows = chunks.keep_first(chunks.identify(merged), "chunk_id", "seq").withColumn("content", render(F.col("segments")))
        if callable(fields_of) and declared:
            rows = rows.withColumn("_fields", _called(fields_of, declared)(F.struct("chunk_id", "content", "segments")))
            rows = rows.withColumns({f: F.col("_fields")[f] for f in declared}).drop("_fields")
        else:
            rows = rows.withColumns({f: (fields_of[f] if fields_of else F.lit(None)).cast("string") for f in declared})
        with self.store.transaction():
            self.chunks.insert(rows.select("chunk_id", "content", chunks.sources(F.col("segments")).alias("sources"), *self.strategy.chunk.fields))
            if self.vectors:
                self.vectors.insert(rows.select("chunk_id", F.col("embedding").alias("vector"), *self.strategy.vector.fields))
            if self.bm25:
                texts = rows.select("chunk_id", F.col("content").alias("text"))
                (self.bm25.rebuild if self.strategy.bm25 == "okapi" else self.bm25.insert)(texts)

    def run(self, folders: list[str], fields_of: dict[str, Column] | None = None) -> None:
        merged = self.merge(self.chunking(folders))
        self.store_chunks(self.embedding(merged) if self.vectors else merged, fields_of)

    def search_in_path(self, vector, k: int, path: str) -> DataFrame:
        """The nearest chunks that touch a path: candidates first, then the top k."""
        one = self.store.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, vector array<float>")
        return self.vectors.search_many(one, k, among=self.chunks.ids_by_path(path)).select("chunk_id", "distance")

    def delete_by_path(self, path: str) -> int:
        """Every chunk that touches the path goes from all tables, in one commit."""
        return self._delete(self.chunks.ids_by_path(path))

    def delete_by_paths(self, paths: DataFrame) -> int:
        """The same for all paths of a table (path) at once."""
        return self._delete(self.chunks.rows().join(paths.select("path"), "path", "left_semi").select("chunk_id").distinct())

    def _delete(self, ids: DataFrame) -> int:
        n = ids.count()
        if n:
            with self.store.transaction():
                if self.vectors:
                    self.vectors.delete_ids(ids)
                if self.bm25:
                    if self.strategy.bm25 == "okapi":
                        left = self.chunks.rows().join(ids, "chunk_id", "left_anti").groupBy("chunk_id").agg(F.first("content").alias("text"))
                        self.bm25.rebuild(left)
                    else:
                        self.bm25.delete(ids)
                self.chunks.delete_ids(ids)
        return n
