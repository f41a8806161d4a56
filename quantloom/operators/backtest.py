"""Backtest of target weights: lagged weights earn, changes cost, impact depends on the portfolio's value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import by_ticker, forward_fill, keep_last
from quantloom.operators.strategy import limit_weights, spine


@dataclass(frozen=True)
class Costs:
    transaction_bps: float = 10.0
    spread_bps: float = 0.0
    impact_bps: float = 0.0
    impact_exponent: float = 0.5
    liquidity_lookback: int = 20
    initial_capital: float = 100_000.0


def trades(prices: DataFrame, weights: DataFrame, costs: Costs = Costs(), cap: float | None = None, cash_buffer: float = 0.0) -> DataFrame:
    """(date, ticker, live, change, ret, liquidity) on every date and ticker of the prices.

    Targets are carried on; ``live`` is the target of the date before; ``change``
    the absolute difference to it. A missing close counts as the last one.
    """
    if "volume" not in prices.columns:
        prices = prices.withColumn("volume", F.lit(0.0))
    dates = weights.select("date").distinct().withColumn("__set", F.lit(True))
    grid = (
        spine(prices)
        .join(prices.select("date", "ticker", "close", "volume"), ["date", "ticker"], "left")
        .join(weights.select("date", "ticker", "weight"), ["date", "ticker"], "left")
        .join(F.broadcast(dates), "date", "left")
    )
    known = F.when(F.col("__set"), F.col("weight"))
    grid = grid.withColumns(
        {
            "weight": F.coalesce(forward_fill(known), F.lit(0.0)),
            "__padded": forward_fill(F.col("close")),
            "__dollars": F.coalesce(F.col("close"), F.lit(0.0)) * F.coalesce(F.col("volume"), F.lit(0.0)),
        }
    )
    if cap is not None:
        grid = limit_weights(grid, cap, cash_buffer)
    w = by_ticker()
    n = max(costs.liquidity_lookback, 1)
    grid = grid.withColumns(
        {
            "live": F.lag("weight", 1, 0.0).over(w),
            "ret": F.coalesce(F.try_divide(F.col("__padded"), F.lag("__padded").over(w)) - 1, F.lit(0.0)),
        }
    )
    return grid.select("date", "ticker", "live", F.abs(F.col("weight") - F.col("live")).alias("change"), "ret", usual_liquidity(F.col("__dollars"), n).alias("liquidity"))


def usual_liquidity(dollars: Column, n: int) -> Column:
    """The mean of the n rows of the ticker before this one; this row's own where that is not above 0."""
    usual = F.avg(dollars).over(by_ticker().rowsBetween(-n, -1))
    return F.when(usual > 0, usual).otherwise(dollars)


def daily(moves: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row a date: gross return, turnover, linear and spread cost, and the parts of the impact cost.

    A name's impact is change * bps * (change * value / liquidity) ** e, so a
    date's impact is value ** e times a sum that does not depend on the value
    (``impact_unit``), plus the names without liquidity (``impact_flat``), whose
    participation is 1. So the path of the value needs one number a date, not the names.
    """
    e, bps = costs.impact_exponent, costs.impact_bps / 10_000.0
    traded, liquid = F.col("change") > 0, F.col("liquidity") > 0
    unit = F.when(traded & liquid, F.col("change") * F.pow(F.try_divide(F.col("change"), F.col("liquidity")), F.lit(e)))
    return moves.groupBy("date").agg(
        F.sum(F.col("live") * F.col("ret")).alias("gross_return"),
        F.sum("change").alias("turnover"),
        (F.coalesce(F.sum(unit), F.lit(0.0)) * bps).alias("impact_unit"),
        (F.coalesce(F.sum(F.when(traded & ~liquid, F.col("change"))), F.lit(0.0)) * bps).alias("impact_flat"),
        F.coalesce(F.max(F.when(traded & liquid, F.try_divide(F.col("change"), F.col("liquidity")))), F.lit(0.0)).alias("participation_unit"),
        F.max((traded & ~liquid).cast("double")).alias("participation_flat"),
    )


def run(prices: DataFrame, weights: DataFrame, costs: Costs = Costs(), benchmark: DataFrame | None = None, cap: float | None = None, cash_buffer: float = 0.0) -> DataFrame:
    """One row a date: gross and net return, turnover, the three costs, participation and the benchmark's return."""
    days = daily(trades(prices, weights, costs, cap, cash_buffer), costs)
    tc, sp = costs.transaction_bps / 10_000.0, costs.spread_bps / 10_000.0
    days = days.withColumns({"linear_cost": F.col("turnover") * tc, "spread_cost": F.col("turnover") * sp})
    if costs.impact_bps > 0:
        days = _with_impact(days, costs)
    else:
        days = days.withColumns({"impact_cost": F.lit(0.0), "max_participation": F.lit(0.0)})
    out = days.withColumn("net_return", F.col("gross_return") - F.col("linear_cost") - F.col("spread_cost") - F.col("impact_cost"))
    out = out.select("date", "gross_return", "net_return", "turnover", "linear_cost", "spread_cost", "impact_cost", "max_participation")
    return out.join(benchmark_returns(benchmark), "date", "left").fillna(0.0, ["benchmark_return"]) if benchmark is not None else out


def benchmark_returns(benchmark: DataFrame) -> DataFrame:
    """(date, benchmark_return); of repeated dates the first row by its close counts."""
    one = keep_last(benchmark.select("date", "close"), ["date"], [F.col("close").asc_nulls_last()])
    w = Window.orderBy("date")
    padded = one.withColumn("close", forward_fill(F.col("close"), w))
    return padded.select("date", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)).alias("benchmark_return"))


def _with_impact(days: DataFrame, costs: Costs) -> DataFrame:
    """Folds the portfolio's value over the dates in order: one row a date, some thousands in all.

    The fold keeps a value and the date's cost; the rows are gathered to one
    array because each step needs the value that the step before left.
    """
    e = F.lit(float(costs.impact_exponent))
    plain = F.col("gross_return") - F.col("linear_cost") - F.col("spread_cost")
    row = F.struct("date", plain.alias("plain"), "impact_unit", "impact_flat", "participation_unit", "participation_flat")
    start = F.struct(F.lit(float(costs.initial_capital)).alias("value"), F.array().cast("array<struct<date:date,impact_cost:double,max_participation:double>>").alias("out"))

    def step(state, x):
        impact = F.pow(state["value"], e) * x["impact_unit"] + x["impact_flat"]
        part = F.greatest(state["value"] * x["participation_unit"], x["participation_flat"])
        return F.struct(
            (state["value"] * (1.0 + x["plain"] - impact)).alias("value"),
            F.concat(state["out"], F.array(F.struct(x["date"].alias("date"), impact.alias("impact_cost"), part.alias("max_participation")))).alias("out"),
        )

    folded = days.agg(F.array_sort(F.collect_list(row)).alias("rows")).select(F.inline(F.aggregate("rows", start, step)["out"]))
    return days.join(folded, "date")
