"""Daily bars from a stream of events, an extension beyond the batch lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(date, ticker, close, high, low, volume) of each day and user; the same plan on a batch and, with its watermark, on a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    cents = F.floor(100 * F.col("value") + 0.5).cast("long")
    grouped = source.groupBy(F.window("ts", "1 day").alias("w"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("ticker")).agg(
        F.sum(cents).alias("sum"), F.count("*").alias("n"), F.max(cents).alias("high"), F.min(cents).alias("low")
    )
    return grouped.select(
        F.to_date("w.start").alias("date"),
        "ticker",
        (F.col("sum").cast("double") / F.col("n") / 100.0).alias("close"),
        (F.col("high") / 100.0).alias("high"),
        (F.col("low") / 100.0).alias("low"),
        F.col("n").cast("double").alias("volume"),
    )
