"""Performance summaries, value curves and evaluation windows of a backtest's daily rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Trading days a year.
YEAR = 252.0


def _annual(growth: Column, n: Column) -> Column:
    return F.when((growth > 0) & (n > 0), F.pow(growth, YEAR / n) - 1).otherwise(0.0)


def with_curves(days: DataFrame) -> DataFrame:
    """Equity, its running maximum and drawdown, and the benchmark's equity, over one row a date."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumn("equity", F.product(1 + F.col("net_return")).over(w)).withColumn("gross_equity", F.product(1 + F.col("gross_return")).over(w))
    if "benchmark_return" in days.columns:
        out = out.withColumn("benchmark_equity", F.product(1 + F.col("benchmark_return")).over(w))
    return out.withColumn("drawdown", running_drawdown(F.col("equity"), Window.orderBy("date")))


def running_drawdown(value: Column, over: WindowSpec) -> Column:
    """How far a value is below its maximum so far."""
    return value / F.max(value).over(over.rowsBetween(Window.unboundedPreceding, 0)) - 1


def summary(days: DataFrame) -> DataFrame:
    """One row of metrics; all 0 for an empty backtest."""
    curve = with_curves(days)
    has_benchmark = "benchmark_return" in days.columns
    r = F.col("net_return")
    first = [
        F.count("*").cast("double").alias("n"),
        F.max_by("equity", "date").alias("e"),
        F.max_by("gross_equity", "date").alias("g"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("sd"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2)))).alias("down"),
        F.min("drawdown").alias("dd"),
        F.avg("turnover").alias("turnover"),
        *[F.avg(c).alias(c) for c in ("linear_cost", "spread_cost", "impact_cost", "max_participation")],
    ]
    if has_benchmark:
        active = r - F.col("benchmark_return")
        first += [F.max_by("benchmark_equity", "date").alias("b"), F.avg(active).alias("active"), F.stddev_pop(active).alias("active_sd")]
    x = curve.agg(*first)
    root = F.sqrt(F.lit(YEAR))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cagr, drawdown, down = _annual(F.col("e"), F.col("n")), zero(F.col("dd")), F.col("down") * root
    out = {
        "total_return": zero(F.col("e") - 1),
        "cagr": zero(cagr),
        "annual_volatility": zero(F.col("sd") * root),
        "downside_volatility": zero(down),
        "sharpe": F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * root).otherwise(0.0),
        "sortino": F.when(down > 0, F.col("mean") * YEAR / down).otherwise(0.0),
        "max_drawdown": drawdown,
        "calmar": F.when(drawdown < 0, cagr / F.abs(drawdown)).otherwise(0.0),
        "avg_daily_turnover": zero(F.col("turnover")),
        "gross_total_return": zero(F.col("g") - 1),
        "gross_cagr": zero(_annual(F.col("g"), F.col("n"))),
        "cost_drag_total_return": zero(F.col("g") - F.col("e")),
        "avg_daily_linear_cost": zero(F.col("linear_cost")),
        "avg_daily_spread_cost": zero(F.col("spread_cost")),
        "avg_daily_market_impact_cost": zero(F.col("impact_cost")),
        "avg_daily_total_cost": zero(F.col("linear_cost") + F.col("spread_cost") + F.col("impact_cost")),
        "avg_daily_max_participation_rate": zero(F.col("max_participation")),
    }
    if has_benchmark:
        benchmark_cagr = _annual(F.col("b"), F.col("n"))
        out |= {
            "benchmark_total_return": zero(F.col("b") - 1),
            "benchmark_cagr": zero(benchmark_cagr),
            "excess_total_return": zero(F.try_divide(F.col("e"), F.col("b")) - 1),
            "excess_cagr": zero(cagr - benchmark_cagr),
            "tracking_error": zero(F.col("active_sd") * root),
            "information_ratio": F.when(F.col("active_sd") > 0, F.col("active") / F.col("active_sd") * root).otherwise(0.0),
        }
    return x.select(*[v.alias(k) for k, v in out.items()])


def value_curve(days: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(date, portfolio_value, benchmark_value): growth over the first date's growth, times the capital."""
    curve = with_curves(days)
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = [(F.col("equity") / F.first("equity").over(w) * capital).alias("portfolio_value")]
    if "benchmark_equity" in curve.columns:
        out.append((F.col("benchmark_equity") / F.first("benchmark_equity").over(w) * capital).alias("benchmark_value"))
    return curve.select("date", *out)


def between(frame: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included."""
    if start is not None:
        frame = frame.where(F.col("date") >= F.to_date(F.lit(start)))
    return frame if end is None else frame.where(F.col("date") <= F.to_date(F.lit(end)))


def evaluation_row(days: DataFrame, model_name: str, capital: float = 100_000.0, **extra: object) -> DataFrame:
    """The summary of a window with its name, dates, capital and profit."""
    ends = value_curve(days, capital).agg(F.min("date").alias("eval_start"), F.max("date").alias("eval_end"), F.max_by("portfolio_value", "date").alias("ending_capital"))
    out = ends.crossJoin(summary(days)).withColumns(
        {"model_name": F.lit(model_name), "starting_capital": F.lit(capital), "profit_dollars": F.col("ending_capital") - capital, **{k: F.lit(v) for k, v in extra.items()}}
    )
    return out.withColumn("window_label", F.concat_ws("_to_", F.col("eval_start").cast("string"), F.col("eval_end").cast("string")))


def evaluation_windows(dates: DataFrame, length: int, step: int, count: int) -> DataFrame:
    """(window, start, end): ``count`` windows of ``length`` dates, each ``step`` dates before the next, from the end, in order of time."""
    if min(length, step, count) <= 0:
        raise ValueError("length, step and count must be positive")
    nth = F.row_number().over(Window.orderBy(F.col("date").desc())) - 1
    back = dates.select("date").distinct().withColumn("back", nth)
    windows = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")
    ranged = back.select("date", "back", windows).where((F.col("back") >= F.col("k") * step) & (F.col("back") < F.col("k") * step + length))
    whole = ranged.groupBy("k").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n")).where(F.col("n") == length)
    return whole.select((F.row_number().over(Window.orderBy("start"))).alias("window"), "start", "end")
