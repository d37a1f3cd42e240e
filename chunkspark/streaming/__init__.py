"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def stream_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_chunks(docs: DataFrame, chunker: Callable[..., DataFrame], **params) -> DataFrame:
    """Chunks of arriving documents: chunkers keep no state, so they work on streams as they are."""
    return chunker(docs, **params)


def stream_distinct(docs: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """Arriving documents without those of equal normalised text within the watermark."""
    keyed = docs.withColumn("__key", F.sha2(T.normalized(F.col(text_col)), 256)).withWatermark(time_col, delay)
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def upsert_index(vectors: DataFrame, path: str, checkpoint: str):
    """Write arriving vectors to a table, batch by batch; a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return vectors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of arriving rows in tumbling windows; late rows beyond the watermark are left out."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("n"))
