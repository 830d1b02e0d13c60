"""Time-bucketed telemetry as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_buckets(spark: SparkSession, path: str, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Maximum and count of each bucket of a folder of event files, as a streaming DataFrame (append mode)."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return events.groupBy(F.window("at", f"{seconds} seconds")).agg(F.max("value").alias("peak"), F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "peak", "n")
