"""Structured Streaming forms of what the batch operators compute; additions, not ports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dwell_windows(events: DataFrame, key: str = "user_id", time: str = "ts", value: str = "value", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count, mean and spread of a key's values by event-time window; rows later than `late` are left out and a
    window's state goes once it has passed."""
    rows = events.withColumn("t_", F.col(time).cast("timestamp")).withWatermark("t_", late)
    return rows.groupBy(key, F.window("t_", window).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).select(key, F.col("w.start").alias("start"), "n", "mean", "std")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Runs of a key's rows with no gap of `gap`: a read's active stretches."""
    rows = events.withColumn("t_", F.col(time).cast("timestamp")).withWatermark("t_", late)
    return rows.groupBy(key, F.session_window("t_", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, available: bool = True):
    """Appends finished windows; with `available` the query ends when the input present at its start is used up."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available else writer).start()
