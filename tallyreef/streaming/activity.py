"""Streaming forms of the activity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, size: str = "30 days", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """Events and their value of each user in windows of time; rows later than the watermark are left out."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "user_id", "n", "value")


def run(events: DataFrame, sink: str, checkpoint: str, **options):
    """Append finished windows to Parquet; exactly once by the sink's log."""
    return activity(events, **options).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
