"""Daily bars from a stream of ticks, kept with a watermark; late ticks beyond it are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """(series_id, d, open, high, low, close, n) from ticks (series_id, ts, price); works on streams and on tables alike."""
    rows = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    bars = rows.groupBy("series_id", F.window("ts", "1 day").alias("w")).agg(
        F.min_by("price", F.struct("ts", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "price")).alias("close"), F.count("*").alias("n")
    )
    return bars.select("series_id", F.to_date("w.start").alias("d"), "open", "high", "low", "close", "n")
