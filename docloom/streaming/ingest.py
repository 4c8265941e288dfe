"""Continuous ingestion: new documents are chunked and replace their partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.chunk import build_chunks
from docloom.sources.io import upsert


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Starts a query that reads Parquet units as they arrive; each batch is an idempotent partition overwrite."""
    units = spark.readStream.schema(schema).parquet(source)
    return units.writeStream.foreachBatch(lambda batch, _: upsert(build_chunks(batch), target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and mean value by type and window, with a watermark; batch and streaming alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
