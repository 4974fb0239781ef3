"""The same transformations on streams: parsing, filters and repairs keep no state, so they run on
arriving rows as they are; counts by time use event time and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inference import repaired

__all__ = ["arrivals", "event_counts", "repaired"]


def arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Layout texts as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; rows later than `late` no longer count."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
