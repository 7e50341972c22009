"""Travel times of edges as a stream: the mean of observations in each window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_weights(observations: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, edge_id, time_min, n) of observations (ts, edge_id, minutes); works on batches and streams alike."""
    seen = observations.withWatermark("ts", late) if observations.isStreaming else observations
    grouped = seen.groupBy(F.window("ts", window).alias("w"), "edge_id").agg(F.avg("minutes").alias("time_min"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "edge_id", "time_min", "n")
