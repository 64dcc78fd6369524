"""Continuous ingestion: a stream of documents (path, text) replaces what the index holds of each path, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import markdown
from quarry.plans.indexing import Pipeline


def ingest(stream: DataFrame, pipeline: Pipeline, checkpoint: str, **trigger):
    """Starts a query that, for every micro-batch, invalidates the batch's paths and stores their new chunks in one commit.

    A batch that is run again after a failure replaces its own rows, so each path ends up stored once."""

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.select("path", "text")
        with pipeline.store.transaction():
            pipeline.delete_by_paths(batch)
            drafts = markdown.chunk(batch, pipeline.strategy.max_token)
            merged = pipeline.merge(drafts.select(F.lit(0).alias("corpus_id"), F.col("path").alias("part"), "seq", "tokens", "segments"))
            pipeline.store_chunks(pipeline.embedding(merged) if pipeline.vectors else merged)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
