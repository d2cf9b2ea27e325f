"""Profiles of a stream: counts, missing values and moments by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.functions import expressions as X


def windowed_profile(stream: DataFrame, time: str, columns: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """A row a window: row count and, of each column, missing values and a number's mean and extremes.

    Events later than ``late`` are left out by the watermark; state is one
    aggregate row a window.
    """
    stats = [F.count(F.lit(1)).alias("row_count")]
    for c in columns:
        v = X.finite(X.number(stream, c))
        stats += [(F.count(F.lit(1)) - F.count(X.value(stream, c))).alias(f"{c}_missing"), F.avg(v).alias(f"{c}_mean"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    timed = stream.withColumn(time, X.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("window")).agg(*stats).select("window.start", "window.end", *(s for s in ["row_count", *(f"{c}_{k}" for c in columns for k in ("missing", "mean", "min", "max"))]))
