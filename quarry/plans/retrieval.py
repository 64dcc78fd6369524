"""Hybrid retrieval: ranked lists of several retrievers, fused by reciprocal rank and joined with stored content."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import models
from quarry.operators import fusion
from quarry.sources.tables import BM25Table, ChunkTable, VectorTable


class VectorRetriever:
    def __init__(self, table: VectorTable, model: Callable):
        self.table, self.model = table, model

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        asked = models.embed(queries, self.model).select("query_id", F.col("embedding").alias("vector"))
        return self.table.search_many(asked, k).select("query_id", "rank", "chunk_id")


class KeywordRetriever:
    def __init__(self, table: BM25Table):
        self.table = table

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        return self.table.search_many(queries, k).select("query_id", "rank", "chunk_id")


class Retrieval:
    """retrievers: names in order, of vec and bm25; a name that is there twice counts twice."""

    def __init__(self, chunks: ChunkTable, retrievers: list[str], vectors: VectorTable | None = None, model: Callable | None = None, keywords: BM25Table | None = None, coarse_top_k: int = 50):
        if not retrievers:
            raise ValueError("at least one retriever is needed")
        self.chunks, self.coarse_top_k, self.lists = chunks, coarse_top_k, []
        for name in retrievers:
            if name == "vec":
                if vectors is None or model is None:
                    raise ValueError("the vec retriever needs a vector table and a model")
                self.lists.append(VectorRetriever(vectors, model))
            elif name == "bm25":
                if keywords is None:
                    raise ValueError("the bm25 retriever needs a keyword index")
                self.lists.append(KeywordRetriever(keywords))
            else:
                raise ValueError(f"no retriever is named {name!r}")

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, chunk_id, score, content, sources, fields) for queries (query_id, text)."""
        found = [r.hits(queries, self.coarse_top_k).withColumn("retriever_idx", F.lit(i)) for i, r in enumerate(self.lists)]
        fused = fusion.rrf(reduce(DataFrame.unionByName, found))
        return fusion.with_content(fused, self.chunks.rows(), k, self.chunks.schema.fields)

    def search(self, query: str, k: int) -> DataFrame:
        one = self.chunks.store.spark.createDataFrame([(0, query)], "query_id int, text string")
        return self.search_many(one, k).drop("query_id")
