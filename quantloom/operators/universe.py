"""Universe snapshots: building them from liquidity, and filtering rows by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import month_ends, rolling


def intervals(snapshots: DataFrame) -> DataFrame:
    """(ticker, start, until): each snapshot holds from its date to the next snapshot's; the last one stays open.

    The dates of all snapshots decide, so one window runs over the distinct dates.
    """
    dates = snapshots.select(F.col("effective_date").alias("start")).distinct()
    dated = dates.withColumn("until", F.lead("start").over(Window.orderBy("start")))
    return snapshots.select("ticker", F.col("effective_date").alias("start")).distinct().join(dated, "start")


def apply_snapshots(features: DataFrame, snapshots: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Rows whose ticker is in the snapshot in force on their date; none before the first snapshot.

    ``days``: the dates of the features (column date), where a shorter way to them is known.

    Dates are turned to the snapshot in force first, so the join is on equal
    keys and not on a range.
    """
    dates = snapshots.select(F.col("effective_date").alias("start")).distinct()
    in_force = Window.orderBy("date", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    days = (features if days is None else days).select("date").distinct()
    marked = days.select("date", F.lit(None).cast("date").alias("start")).unionAll(dates.select(F.col("start").alias("date"), "start"))
    at = marked.withColumn("start_in_force", F.last("start", ignorenulls=True).over(in_force)).where("start is null").select("date", "start_in_force")
    members = snapshots.select(F.col("effective_date").alias("start_in_force"), "ticker").distinct()
    return features.join(at, "date").join(members, ["start_in_force", "ticker"], "left_semi").drop("start_in_force")


def build_snapshots(prices: DataFrame, size: int = 30, min_close: float = 5.0, min_dollar_volume_60: float = 50_000_000.0, min_age_days: int = 252) -> DataFrame:
    """At each month's last date, the most liquid tickers of the past 60 rows, without looking ahead."""
    if size <= 0:
        raise ValueError("size must be positive")
    frame = prices.withColumns(
        {
            "avg_dollar_volume_60": rolling(F.avg, F.col("close") * F.col("volume"), 60),
            "universe_age_days": F.datediff("date", F.min("date").over(Window.partitionBy("ticker"))).cast("double"),
        }
    )
    fit = frame.join(month_ends(prices), "date", "left_semi").where(
        (F.coalesce("close", F.lit(0.0)) >= min_close)
        & (F.coalesce("avg_dollar_volume_60", F.lit(0.0)) >= min_dollar_volume_60)
        & (F.col("universe_age_days") >= float(min_age_days))
    )
    best = Window.partitionBy("date").orderBy(F.col("avg_dollar_volume_60").desc(), "ticker")
    ranked = fit.withColumn("selection_rank", F.row_number().over(best)).where(F.col("selection_rank") <= size)
    return ranked.select(
        F.col("date").alias("effective_date"),
        "ticker",
        "selection_rank",
        F.col("avg_dollar_volume_60").alias("selection_score"),
        "avg_dollar_volume_60",
        "close",
        "universe_age_days",
    )
