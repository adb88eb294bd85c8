"""Cluster assignment on a stream.

Prediction is a projection over inlined centroids, so a stream needs no state
for it; counts per time window keep state only up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.frame import IntervalFrame
from spanforge.operators.kmeans import IntervalKMeans


def assigned(stream: DataFrame, model: IntervalKMeans) -> DataFrame:
    """``stream`` with its rows' ``cluster``; works on batches alike."""
    return model.predict(IntervalFrame(stream))


def cluster_counts(stream: DataFrame, model: IntervalKMeans, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(begin, end, cluster, n) per window of ``time``; rows later than ``late`` behind the newest are left out once their window is closed."""
    rows = assigned(stream.withWatermark(time, late), model)
    counts = rows.groupBy(F.window(time, window).alias("w"), "cluster").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "cluster", "n")
