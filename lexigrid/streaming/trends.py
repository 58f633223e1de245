"""Trends over a stream: an extension, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, axis: str, every: str, late: str, groups: list[str]) -> DataFrame:
    """(period, groups..., sequential_count) of event-time windows; works on batches as well."""
    marked = stream.withWatermark(axis, late)
    counted = marked.groupBy(F.window(axis, every), *groups).agg(F.count("*").alias("sequential_count"))
    return counted.select(F.col("window.start").alias("period"), *groups, "sequential_count")
