"""The activity trend over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, glob: str = "events.parquet") -> DataFrame:
    """Events as a stream of files; times as timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{path}/{glob}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_trend(events: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Events and their summed value by window and type; a window closes once the watermark passes it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
