"""Incremental counts by grid cell and time window, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarix.operators.spatial_join import cell


def grid_counts(events: DataFrame, size: float, window: str = "1 hour", delay: str = "2 hours", *, time_col: str = "ts", by: list[str] | None = None) -> DataFrame:
    """(start, cx, cy, *by, n) from a stream or table of points (x, y, time)."""
    late = events.withWatermark(time_col, delay) if events.isStreaming else events
    w = F.window(time_col, window)
    return late.groupBy(w.alias("w"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"), *(by or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cx", "cy", *(by or []), "n")
