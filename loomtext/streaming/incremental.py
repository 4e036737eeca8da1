"""Incremental ingest as a stream: an extension, built on content-derived ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators.lifecycle import Store


def upsert_stream(chunks: DataFrame, store: Store, collection: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch of ``chunks`` into the store by id, as a delta; a batch that runs twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.delta(collection, batch)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and window with late data up to ``late``; batch and stream alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
