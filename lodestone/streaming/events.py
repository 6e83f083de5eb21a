"""Streams of events: windowed counts with late data, last-wins state, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    """events with ts as an instant, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums by type and window; rows later than `late` are dropped by the watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = timed(events).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_by_key(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the highest order of each key so far (update or complete mode)."""
    rest = [c for c in events.columns if c not in keys]
    out = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return out.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
