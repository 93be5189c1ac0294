"""Streaming ingestion: new units become chunks and postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evidara.operators.chunk import chunk_units


def stream_units(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_chunks(units: DataFrame, out: str, checkpoint: str, size: int = 1024, overlap: int = 128, available_now: bool = True) -> StreamingQuery:
    """Append the chunks of arriving units to ``out``; chunking is stateless, so no watermark.

    Ids are content-addressed, and the Parquet sink's log commits each batch once, so a restart
    from ``checkpoint`` neither loses nor repeats chunks.
    """
    writer = chunk_units(units, size, overlap).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark, for monitoring an ingestion feed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
