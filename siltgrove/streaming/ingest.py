"""Streaming ingestion: new chunks are embedded and hung under the nearest node of the first layer, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import embedding_of
from ..operators.nearest import search


def attach(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """node_id, text, embedding and parent_id of chunks (node_id, text): the nearest of the parents (node_id,
    embedding) by cosine, ties to the lesser id."""
    new = chunks.select("node_id", "text", embedding_of(F.col("text")).alias("embedding"))
    near = search(parents.select(F.col("node_id").alias("vec_id"), "embedding"), new.select(F.col("node_id").alias("vec_id"), "embedding"), 1)
    return new.join(near.select(F.col("query_id").alias("node_id"), F.col("vec_id").alias("parent_id")), "node_id", "left")


def ingest(stream: DataFrame, parents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A query that appends each micro-batch of a stream of chunks to the leaves at path, once each: a batch that is
    run again overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        attach(rows.dropDuplicates(["node_id"]), parents).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events per type and window of event time, with a watermark: bounded state, late rows beyond it dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
