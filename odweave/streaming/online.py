"""The operators that also run on streams: row-wise ones and plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_od_totals(events: DataFrame, groups: DataFrame, *, ts: str, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Windowed sums of (o, d, value) events by zone group, late data bounded by a watermark."""
    rows = groups.select(F.col("zone").alias("o"), F.col("group").alias("row_group"))
    cols = groups.select(F.col("zone").alias("d"), F.col("group").alias("col_group"))
    tied = events.withWatermark(ts, delay).join(rows, "o").join(cols, "d")
    return tied.groupBy(F.window(ts, window).alias("w"), "row_group", "col_group").agg(F.sum("value").alias("value"))


def stream_histogram(events: DataFrame, value: str, *, bin_start: float, bin_end: float, bin_step: float) -> DataFrame:
    """Counts by bin in complete mode; empty bins are the caller's to add, as a stream has no outer range."""
    v = F.col(value)
    n = int((bin_end - bin_start) / bin_step)
    at = F.when((v >= bin_start) & (v <= bin_end), F.least(F.floor((v - bin_start) / bin_step).cast("int"), F.lit(n - 1)))
    return events.groupBy(at.alias("position")).count().where("position is not null")
