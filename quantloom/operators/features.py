"""Rolling, cross-section and sector features of a price panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import by_ticker, change, forward_fill, keep_last, rank_percentile, rolling, share_true, zscore
from quantloom.operators.universe import apply_snapshots


@dataclass(frozen=True)
class Eligibility:
    min_close_price: float = 0.0
    min_dollar_volume_20: float = 0.0
    min_universe_age_days: int = 0


def _mean(x, n, over=None):
    return rolling(F.avg, x, n, over=over)


def ratio(a: str, b: str):
    return F.try_divide(F.col(a), F.col(b)) - 1


def price_features(prices: DataFrame) -> DataFrame:
    """Returns, volatility, averages, drawdowns and liquidity by ticker; lags and frames count rows, not days.

    A missing close counts as the one before it for returns only.
    """
    w = by_ticker()
    out = prices.withColumn("__padded", forward_fill(F.col("close")))
    close, volume = F.col("close"), F.col("volume")
    returns = {f"ret_{k}": change(F.col("__padded"), k) for k in (1, 5, 20, 60, 120)}
    out = out.withColumns({**returns, "dollar_volume": close * volume, "__range": F.try_divide(F.col("high") - F.col("low"), close)})
    out = out.withColumns(
        {
            "vol_20": rolling(F.stddev_samp, F.col("ret_1"), 20),
            "vol_60": rolling(F.stddev_samp, F.col("ret_1"), 60),
            "sma_20": _mean(close, 20, w),
            "sma_50": _mean(close, 50, w),
            "sma_200": _mean(close, 200, w),
            "drawdown_20": F.try_divide(close, rolling(F.max, close, 20)) - 1,
            "drawdown_60": F.try_divide(close, rolling(F.max, close, 60)) - 1,
            "dollar_volume_20": _mean(F.col("dollar_volume"), 20),
            "volume_ratio_20": F.try_divide(volume, _mean(volume, 20)) - 1,
            "range_pct_20": _mean(F.col("__range"), 20),
        }
    )
    return out.withColumns(
        {
            "price_vs_sma20": ratio("close", "sma_20"),
            "price_vs_sma50": ratio("close", "sma_50"),
            "price_vs_sma200": ratio("close", "sma_200"),
            "sma20_vs_sma50": ratio("sma_20", "sma_50"),
            "sma50_vs_sma200": ratio("sma_50", "sma_200"),
            "log_dollar_volume_20": F.log1p("dollar_volume_20"),
            "vol_ratio_20_60": ratio("vol_20", "vol_60"),
            "momentum_20_60_gap": F.col("ret_20") - F.col("ret_60"),
            "trend_ok": F.coalesce((close > F.col("sma_50")) & (F.col("sma_50") > F.col("sma_200")), F.lit(False)),
        }
    ).drop("__padded", "__range")


BENCHMARK_COLUMNS = {
    "benchmark_ret_1": 0.0,
    "benchmark_ret_20": 0.0,
    "benchmark_ret_60": 0.0,
    "benchmark_vol_20": 0.0,
    "benchmark_drawdown_60": 0.0,
    "benchmark_price_vs_sma200": 0.0,
    "benchmark_sma50_vs_sma200": 0.0,
    "market_trend_ok": False,
    "market_high_vol_regime": False,
}


def benchmark_features(benchmark: DataFrame) -> DataFrame:
    """A row for each date of one series; of repeated dates the last row by its columns counts.

    The windows run over a single partition: the series has one row a date.
    """
    w = Window.orderBy("date")
    close = F.col("close")
    out = keep_last(benchmark.select("date", "close"), ["date"], [close.desc_nulls_last()])
    out = out.withColumn("__padded", forward_fill(close, w))
    out = out.withColumns({f"benchmark_ret_{k}": change(F.col("__padded"), k, w) for k in (1, 20, 60)})
    out = out.withColumns(
        {
            "benchmark_vol_20": rolling(F.stddev_samp, F.col("benchmark_ret_1"), 20, over=w),
            "sma_50": _mean(close, 50, w),
            "sma_200": _mean(close, 200, w),
            "benchmark_drawdown_60": F.try_divide(close, rolling(F.max, close, 60, over=w)) - 1,
        }
    )
    usual = _mean(F.col("benchmark_vol_20"), 60, w)
    return out.withColumns(
        {
            "benchmark_price_vs_sma200": ratio("close", "sma_200"),
            "benchmark_sma50_vs_sma200": ratio("sma_50", "sma_200"),
            "market_trend_ok": F.coalesce((close > F.col("sma_50")) & (F.col("sma_50") > F.col("sma_200")), F.lit(False)),
            "market_high_vol_regime": F.coalesce(F.col("benchmark_vol_20") > usual, F.lit(False)),
        }
    ).select("date", *BENCHMARK_COLUMNS)


def context_features(features: DataFrame, rules: Eligibility = Eligibility()) -> DataFrame:
    """What depends on the other rows of a date, a sector or the ticker's whole stay in the universe."""
    missing = {c: F.lit(v) for c, v in BENCHMARK_COLUMNS.items() if c not in features.columns}
    out = features.withColumns(missing) if missing else features
    out = out.withColumns(
        {
            "rel_ret_20": F.col("ret_20") - F.col("benchmark_ret_20"),
            "rel_ret_60": F.col("ret_60") - F.col("benchmark_ret_60"),
            "benchmark_momentum_gap": F.col("benchmark_ret_20") - F.col("benchmark_ret_60"),
            "first_universe_date": F.min("date").over(Window.partitionBy("ticker")),
        }
    )
    out = out.withColumns(
        {
            "relative_momentum_gap": F.col("rel_ret_20") - F.col("rel_ret_60"),
            "universe_age_days": F.datediff("date", "first_universe_date").cast("double"),
        }
    )
    eligible = (
        (F.coalesce("close", F.lit(0.0)) >= rules.min_close_price)
        & (F.coalesce("dollar_volume_20", F.lit(0.0)) >= rules.min_dollar_volume_20)
        & (F.coalesce("universe_age_days", F.lit(-1.0)) >= float(rules.min_universe_age_days))
    )
    day, sector = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    trend = F.col("trend_ok")
    out = out.withColumns(
        {
            "eligible_universe": eligible,
            "cs_ret_20_z": zscore(F.col("ret_20"), day),
            "cs_ret_60_z": zscore(F.col("ret_60"), day),
            "cs_rel_ret_20_z": zscore(F.col("rel_ret_20"), day),
            "cs_vol_20_z": zscore(F.col("vol_20"), day),
            "universe_momentum_rank_pct": rank_percentile(F.col("rel_ret_20"), ["date"]),
            "universe_vol_rank_pct": rank_percentile(F.col("vol_20"), ["date"]),
            "market_breadth_trend_share": share_true(trend, day),
            "sector_size": F.count("ticker").over(sector),
            "sector_ret_20_mean": F.avg("ret_20").over(sector),
            "sector_rel_ret_20_mean": F.avg("rel_ret_20").over(sector),
            "sector_vol_20_mean": F.avg("vol_20").over(sector),
            "sector_momentum_rank_pct": rank_percentile(F.col("rel_ret_20"), ["date", "sector"]),
            "sector_trend_share": share_true(trend, sector),
        }
    )
    return out.withColumns({f"sector_{c}_gap": F.col(c) - F.col(f"sector_{c}_mean") for c in ("ret_20", "rel_ret_20", "vol_20")})


def build_features(
    prices: DataFrame,
    benchmark: DataFrame | None = None,
    metadata: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    rules: Eligibility = Eligibility(),
) -> DataFrame:
    """All features. Rolling windows see the whole price history; the universe applies before the context."""
    out = price_features(prices)
    if metadata is not None:
        out = out.join(metadata.withColumn("ticker", F.upper("ticker")), "ticker", "left")
    out = out.withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")) if "sector" in out.columns else F.lit("UNKNOWN"))
    if benchmark is not None:
        out = out.join(benchmark_features(benchmark), "date", "left")
    if snapshots is not None:
        out = apply_snapshots(out, snapshots, prices)
    return context_features(out, rules)
