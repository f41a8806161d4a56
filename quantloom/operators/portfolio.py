"""Target portfolios, rebalance orders and positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.strategy import limit_weights


@dataclass(frozen=True)
class Risk:
    capital_base: float = 100_000.0
    cash_buffer: float = 0.05
    max_position_weight: float = 0.25
    min_trade_notional: float = 250.0
    allow_fractional_shares: bool = False


def target_shares(notional: Column, close: Column, fractional: bool) -> Column:
    shares = F.try_divide(notional, close)
    return F.when(close <= 0, F.lit(0.0)).otherwise(F.bround(shares, 6) if fractional else F.floor(shares).cast("double"))


def as_of(frame: DataFrame, date: str | None = None) -> DataFrame:
    """Rows of the last date at or before ``date`` (of all, without one)."""
    until = frame if date is None else frame.where(F.col("date") <= F.to_date(F.lit(date)))
    last = until.agg(F.max("date").alias("date"))
    return until.join(F.broadcast(last), "date", "left_semi")


def latest_prices(prices: DataFrame, date: str | None = None) -> DataFrame:
    """(ticker, close) of each ticker's last row at or before the date."""
    until = prices if date is None else prices.where(F.col("date") <= F.to_date(F.lit(date)))
    return until.groupBy(F.upper("ticker").alias("ticker")).agg(F.max_by("close", "date").alias("close"))


def target_portfolio(weights: DataFrame, prices: DataFrame, risk: Risk = Risk(), date: str | None = None) -> DataFrame:
    """The names with a weight on the last date at or before ``date``, limited, in shares at that date's close.

    A name without a close on that date is an error when the rows are read.
    """
    at = as_of(weights, date)
    held = at.where("weight > 0").withColumn("raw_weight", F.col("weight"))
    limited = limit_weights(held, risk.max_position_weight, risk.cash_buffer).withColumnRenamed("weight", "target_weight")
    closes = prices.select(F.upper("ticker").alias("ticker"), "date", "close")
    priced = limited.join(closes, ["date", "ticker"], "left")
    close = F.when(F.col("close").isNotNull(), F.col("close")).otherwise(F.raise_error(F.concat(F.lit("no close for "), F.col("ticker"))).cast("double"))
    out = priced.withColumn("close", close).withColumn("target_notional", F.col("target_weight") * risk.capital_base)
    out = out.withColumn("target_shares", target_shares(F.col("target_notional"), F.col("close"), risk.allow_fractional_shares))
    out = out.withColumn("target_notional_after_rounding", F.col("target_shares") * F.col("close"))
    return out.select("date", "ticker", "raw_weight", "target_weight", "close", "target_notional", "target_shares", "target_notional_after_rounding")


def rebalance_orders(portfolio: DataFrame, positions: DataFrame, risk: Risk = Risk(), latest: DataFrame | None = None) -> DataFrame:
    """Orders that lead from the positions to the portfolio; names that leave are sold whole."""
    wanted = portfolio.select("ticker", "date", "close", "target_weight", "target_shares", "target_notional_after_rounding")
    both = positions.select(F.upper("ticker").alias("ticker"), "shares").join(wanted, "ticker", "full")
    if latest is not None:
        both = both.join(latest.select("ticker", F.col("close").alias("latest_close")), "ticker", "left").withColumn("close", F.coalesce("close", "latest_close"))
    both = both.join(F.broadcast(portfolio.agg(F.max("date").alias("last_date"))), how="cross").withColumn("date", F.coalesce("date", "last_date"))
    zero = ["shares", "target_shares", "close", "target_weight", "target_notional_after_rounding"]
    out = both.fillna(0.0, zero).withColumn("order_shares", F.col("target_shares") - F.col("shares"))
    out = out.withColumns({"trade_notional": F.abs("order_shares") * F.col("close"), "side": side(F.col("order_shares"))})
    out = out.where((F.col("side") != "HOLD") & (F.col("trade_notional") >= risk.min_trade_notional))
    return out.select("date", "ticker", "side", "order_shares", "close", "trade_notional", "target_weight", "target_notional_after_rounding")


def side(shares: Column) -> Column:
    return F.when(shares > 0, "BUY").when(shares < 0, "SELL").otherwise("HOLD")


def next_positions(portfolio: DataFrame) -> DataFrame:
    return portfolio.select("ticker", F.col("target_shares").alias("shares"))


def positions_value(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: positions_value, and the tickers without a price, which count 0."""
    priced = positions.join(prices.select("ticker", "close"), "ticker", "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("close").isNull(), F.col("ticker"))))
    return priced.agg(F.coalesce(F.sum(F.col("shares") * F.coalesce("close", F.lit(0.0))), F.lit(0.0)).alias("positions_value"), missing.alias("missing"))


def portfolio_summary(portfolio: DataFrame, orders: DataFrame) -> DataFrame:
    """One row of counts, totals and the sorted tickers."""
    held = portfolio.agg(F.count("*").alias("holdings"), F.sum("target_weight").alias("total_weight"), F.sum("target_notional_after_rounding").alias("total_notional"), F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("tickers"))
    traded = orders.agg(F.count("*").alias("orders"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"), F.coalesce(F.sum("trade_notional"), F.lit(0.0)).alias("traded_notional"))
    return held.crossJoin(traded)


def reconcile(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(ticker, expected_shares, actual_shares, share_delta, status) of the union of both positions."""
    both = expected.select("ticker", F.col("shares").alias("expected_shares")).join(actual.select("ticker", F.col("shares").alias("actual_shares")), "ticker", "full").fillna(0.0)
    delta = F.col("actual_shares") - F.col("expected_shares")
    return both.withColumn("share_delta", delta).withColumn("status", F.when(F.abs(delta) > tolerance, "mismatch").otherwise("ok"))


def guardrails(orders: DataFrame, max_orders: int, max_total: float, max_single: float, seen_dates: DataFrame | None = None) -> DataFrame:
    """One row: order_count, total and largest notional, and the names of the rules that the orders break."""
    facts = orders.agg(
        F.count("*").alias("order_count"),
        F.coalesce(F.sum("trade_notional"), F.lit(0.0)).alias("total_notional"),
        F.coalesce(F.max("trade_notional"), F.lit(0.0)).alias("largest_notional"),
        F.max("date").alias("market_date"),
    )
    if seen_dates is None:
        facts = facts.withColumn("seen", F.lit(False))
    else:
        seen = seen_dates.select(F.col("market_date").alias("__d")).distinct()
        facts = facts.join(seen, F.col("market_date") == F.col("__d"), "left").withColumn("seen", F.col("__d").isNotNull()).drop("__d")
    broken = F.array_compact(
        F.array(
            F.when(F.col("order_count") > max_orders, "max_order_count"),
            F.when(F.col("total_notional") > max_total, "max_total_notional"),
            F.when(F.col("largest_notional") > max_single, "max_single_notional"),
            F.when(F.col("seen"), "duplicate_market_date"),
        )
    )
    return facts.withColumn("violations", broken).withColumn("allowed", F.size("violations") == 0).drop("seen")


def positions_after(positions: DataFrame, fills: DataFrame) -> DataFrame:
    """Positions with the fills applied; names that fall to 0 leave."""
    moved = fills.select("ticker", F.when(F.col("side") == "BUY", F.col("filled_shares")).otherwise(-F.col("filled_shares")).alias("shares"))
    return positions.select("ticker", "shares").unionByName(moved).groupBy("ticker").agg(F.sum("shares").alias("shares")).where("shares > 0")
