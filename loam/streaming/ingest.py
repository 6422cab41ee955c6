"""Incremental ingestion: a stream of documents upserted into a collection batch by batch.

Every micro-batch runs the batch plan, so results do not depend on how documents were grouped into
batches; repeating a batch after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loam.plans.pipeline import Pipeline

DOCUMENT = "doc_id string, text string, title string, source_uri string, format string"


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines files of documents that arrive in a folder."""
    return spark.readStream.schema(DOCUMENT).json(folder)


def ingest_stream(pipeline: Pipeline, documents: DataFrame, collection: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the query; with ``once`` it handles what is there and stops."""

    def store(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            pipeline.ingest(batch, collection).count()

    writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return writer.trigger(availableNow=True).start() if once else writer.start()
