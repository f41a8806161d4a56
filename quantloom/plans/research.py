"""Queries of the price research lane: panel, features, universe, selection, backtest and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, keep_last, minus_business_days, month_ends, r6, rolling, rounded_to, zscore
from quantloom.operators import backtest, features, metrics, signals, strategy, universe
from quantloom.plans.sql import half_up, with_tables, z
from quantloom.plans.sql import r6 as q6
from quantloom.shared import stage_table
from quantloom.sources import panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RULES = features.Eligibility(min_close_price=5.0, min_dollar_volume_20=1000.0, min_universe_age_days=30)
PICK = strategy.Rules(top_n=4, min_history=20, trend_mode="soft", llm_weight=0.10)
COSTS = backtest.Costs(transaction_bps=10, spread_bps=5, impact_bps=15, impact_exponent=0.5, liquidity_lookback=20, initial_capital=100.0)


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
                ORACLE_SQL[name] = half_up(sql)
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places."""
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _snapshots(prices: DataFrame) -> DataFrame:
    return universe.build_snapshots(prices, size=30, min_close=5.0, min_dollar_volume_60=1000.0, min_age_days=252)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(panel.prices(spark, sf_dir))


def all_features(spark: SparkSession, sf_dir: str, bars: panel.Bars | None = None) -> DataFrame:
    bars = bars or panel.bars(spark, sf_dir)
    return features.build_features(bars.prices, bars.benchmark, panel.metadata(spark, sf_dir), _snapshots(bars.prices), RULES)


def short_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.signals(spark, sf_dir).where("horizon_bucket = 'short'")


def selection_frame(spark: SparkSession, sf_dir: str, bars: panel.Bars | None = None) -> DataFrame:
    """The columns that a selection reads; written once, since ranking, spine and month ends each read them."""
    needed = ("date", "ticker", "close", "ret_20", "ret_60", "vol_20", "trend_ok", "eligible_universe")
    return stage_table(all_features(spark, sf_dir, bars).select(*needed), "features")[0]


def weights(spark: SparkSession, sf_dir: str, bars: panel.Bars | None = None) -> DataFrame:
    return strategy.target_weights(selection_frame(spark, sf_dir, bars), PICK, short_scores(spark, sf_dir))


def backtest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a date; written once, since metrics read it several times."""
    bars = panel.bars(spark, sf_dir)
    days = backtest.run(bars.prices, weights(spark, sf_dir, bars), COSTS, bars.benchmark, cap=0.02, cash_buffer=0.04)
    return stage_table(days, "backtest")[0]


# --- panel ---------------------------------------------------------------


@query("s1_prices", with_tables("SELECT date, ticker, open, high, low, round(close, 6) AS close, volume FROM prices"))
def s1_prices(spark, sf_dir):
    return panel.prices(spark, sf_dir).withColumn("close", r6(F.col("close")))


@query("s8_frame_summary", with_tables("SELECT count(*) AS row_count, count(DISTINCT ticker) AS ticker_count, min(date) AS min_date, max(date) AS max_date FROM prices"))
def s8_frame_summary(spark, sf_dir):
    from quantloom.sources.files import frame_summary

    return frame_summary(panel.prices(spark, sf_dir))


@query("s9_metadata", with_tables("SELECT ticker, sector, industry FROM metadata"))
def s9_metadata(spark, sf_dir):
    return panel.metadata(spark, sf_dir)


@query("signals_daily", with_tables("SELECT date, ticker, horizon_bucket, llm_score, document_count FROM signals"))
def signals_daily(spark, sf_dir):
    return panel.signals(spark, sf_dir)


# --- features ------------------------------------------------------------


def _features(name: str, *columns: str, table: str = "price_feats", keys: tuple[str, ...] = ("date", "ticker"), exact: tuple[str, ...] = ()) -> None:
    sql = with_tables(f"SELECT {', '.join([*keys, *exact, *[q6(c) for c in columns]])} FROM {table}")

    @query(name, sql)
    def own(spark, sf_dir):
        if table == "price_feats":
            frame = features.price_features(panel.prices(spark, sf_dir))
        elif table == "bench_feats":
            frame = features.benchmark_features(panel.benchmark(spark, sf_dir))
        else:
            frame = all_features(spark, sf_dir)
        return frame.select(*keys, *exact, *[r6(F.col(c)).alias(c) for c in columns])


_features("w1_returns", "ret_1", "ret_5", "ret_20", "ret_60", "ret_120")
_features("w2_volatility", "vol_20", "vol_60")
_features("w3_moving_averages", "sma_20", "sma_50", "sma_200")
_features("w4_drawdown", "drawdown_20", "drawdown_60")
_features("w5_liquidity_range", "dollar_volume_20", "volume_ratio_20", "range_pct_20")
_features("w6_benchmark_features", "benchmark_ret_1", "benchmark_ret_20", "benchmark_ret_60", "benchmark_vol_20", "benchmark_drawdown_60", "benchmark_price_vs_sma200", "benchmark_sma50_vs_sma200", table="bench_feats", keys=("date",), exact=("market_trend_ok", "market_high_vol_regime"))
_features("p1_ratio_features", "price_vs_sma20", "price_vs_sma50", "price_vs_sma200", "sma20_vs_sma50", "sma50_vs_sma200")
_features("p2_dollar_volume", "dollar_volume", "log_dollar_volume_20")
_features("p4_vol_ratio_gap", "vol_ratio_20_60", "momentum_20_60_gap")
_features("p5_trend_flag", "close", exact=("trend_ok",))
_features("p6_relative_returns", "rel_ret_20", "rel_ret_60", "benchmark_momentum_gap", "relative_momentum_gap", table="feats")
_features("w7_cross_section_z", "cs_ret_20_z", "cs_ret_60_z", "cs_rel_ret_20_z", "cs_vol_20_z", table="feats")
_features("w8_rank_percentile", "universe_momentum_rank_pct", "universe_vol_rank_pct", "sector_momentum_rank_pct", table="feats")
_features("w9_breadth", "market_breadth_trend_share", "sector_trend_share", table="feats")
_features("w10_sector_context", "sector_ret_20_gap", "sector_rel_ret_20_gap", "sector_vol_20_gap", table="feats", exact=("sector_size",))
_features("w11_universe_age", "universe_age_days", table="feats", exact=("first_universe_date",))
_features("f1_eligibility", "close", table="feats", exact=("eligible_universe",))
_features("j2_features_benchmark", "ret_20", "benchmark_ret_20", "benchmark_vol_20", table="feats", exact=("sector", "market_trend_ok"))

_Q1 = (
    "ret_1 ret_5 ret_20 ret_60 ret_120 rel_ret_20 rel_ret_60 vol_20 vol_60 vol_ratio_20_60 price_vs_sma20 price_vs_sma50 price_vs_sma200 sma20_vs_sma50 sma50_vs_sma200 "
    "benchmark_ret_20 benchmark_ret_60 benchmark_vol_20 benchmark_drawdown_60 benchmark_price_vs_sma200 benchmark_sma50_vs_sma200 drawdown_20 drawdown_60 dollar_volume_20 "
    "universe_age_days volume_ratio_20 log_dollar_volume_20 range_pct_20 momentum_20_60_gap benchmark_momentum_gap relative_momentum_gap cs_ret_20_z cs_ret_60_z cs_rel_ret_20_z "
    "cs_vol_20_z universe_momentum_rank_pct universe_vol_rank_pct market_breadth_trend_share sector_ret_20_gap sector_rel_ret_20_gap sector_vol_20_gap sector_momentum_rank_pct sector_trend_share"
).split()
_features("q1_build_features", *_Q1, table="feats", exact=("sector", "trend_ok", "market_trend_ok", "market_high_vol_regime", "eligible_universe", "sector_size"))


@query("p3_intraday_range", with_tables("SELECT date, ticker, round((high - low) / nullif(close, 0), 6) AS intraday_range FROM prices"))
def p3_intraday_range(spark, sf_dir):
    return panel.prices(spark, sf_dir).select("date", "ticker", r6(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).alias("intraday_range"))


@query("j1_prices_metadata", with_tables("SELECT date, ticker, round(close, 6) AS close, coalesce(sector, 'UNKNOWN') AS sector, industry FROM prices LEFT JOIN metadata USING (ticker)"))
def j1_prices_metadata(spark, sf_dir):
    out = panel.prices(spark, sf_dir).join(panel.metadata(spark, sf_dir), "ticker", "left")
    return out.select("date", "ticker", r6(F.col("close")).alias("close"), F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"), "industry")


# --- universe ------------------------------------------------------------


@query("q4_universe_snapshots", with_tables("SELECT effective_date, ticker, selection_rank, round(avg_dollar_volume_60, 4) AS avg_dollar_volume_60, round(close, 6) AS close, universe_age_days FROM snapshots"))
def q4_universe_snapshots(spark, sf_dir):
    return snapshots(spark, sf_dir).select("effective_date", "ticker", "selection_rank", rounded_to(F.col("avg_dollar_volume_60"), 4).alias("avg_dollar_volume_60"), rounded_to(F.col("close"), 6).alias("close"), "universe_age_days")


@query("w21_adv60", with_tables("SELECT date, ticker, round(avg_dollar_volume_60, 4) AS avg_dollar_volume_60 FROM liquid"))
def w21_adv60(spark, sf_dir):
    adv = rolling(F.avg, F.col("close") * F.col("volume"), 60)
    return panel.prices(spark, sf_dir).select("date", "ticker", F.round(adv, 4).alias("avg_dollar_volume_60"))


@query("j4_universe_interval_join", with_tables("SELECT date, ticker, round(close, 6) AS close FROM in_universe"))
def j4_universe_interval_join(spark, sf_dir):
    kept = universe.apply_snapshots(panel.prices(spark, sf_dir), snapshots(spark, sf_dir))
    return kept.select("date", "ticker", r6(F.col("close")).alias("close"))


@query("s10_snapshot_intervals", with_tables("SELECT ticker, start, until FROM snap_dates JOIN snapshots ON effective_date = start"))
def s10_snapshot_intervals(spark, sf_dir):
    return universe.intervals(snapshots(spark, sf_dir)).select("ticker", "start", "until")


@query("a1_month_ends", with_tables("SELECT date FROM ends"))
def a1_month_ends(spark, sf_dir):
    return month_ends(panel.prices(spark, sf_dir))


@query("s12_ordered_distinct_tickers", with_tables("SELECT ticker, row_number() OVER (ORDER BY first_date, first_rank, ticker) AS position FROM (SELECT ticker, min(effective_date) AS first_date, min_by(selection_rank, effective_date) AS first_rank FROM snapshots GROUP BY ticker)"))
def s12_ordered_distinct_tickers(spark, sf_dir):
    first = snapshots(spark, sf_dir).groupBy("ticker").agg(F.min(F.struct("effective_date", "selection_rank")).alias("f"))
    return first.select("ticker", F.row_number().over(Window.orderBy("f.effective_date", "f.selection_rank", "ticker")).alias("position"))


# --- signals and selection -----------------------------------------------


@query("j5_asof_scores", with_tables("SELECT p.date, p.ticker, round(coalesce(s.llm_score, 0), 6) AS llm_score, coalesce(s.document_count, 0) AS document_count FROM prices p ASOF LEFT JOIN (SELECT * FROM signals WHERE horizon_bucket = 'short') s ON p.ticker = s.ticker AND p.date >= s.date"))
def j5_asof_scores(spark, sf_dir):
    out = signals.attach_scores(panel.prices(spark, sf_dir), short_scores(spark, sf_dir), ("llm_score", "document_count"))
    return out.select("date", "ticker", r6(F.col("llm_score")).alias("llm_score"), "document_count")


@query("j6_asof_reverse", with_tables("SELECT s.date, s.ticker, s.horizon_bucket, s.llm_score, p.date AS feature_date, round(p.close, 6) AS close FROM signals s ASOF LEFT JOIN prices p ON p.ticker = s.ticker AND s.date >= p.date"))
def j6_asof_reverse(spark, sf_dir):
    prices = panel.prices(spark, sf_dir).select("ticker", "date", F.col("date").alias("feature_date"), "close")
    out = signals.asof_join(panel.signals(spark, sf_dir), prices, ["ticker"], ["feature_date", "close"])
    return out.select("date", "ticker", "horizon_bucket", "llm_score", "feature_date", r6(F.col("close")).alias("close"))


@query("f2_rebalance_eligible", with_tables("SELECT date, ticker, round(ret_20, 6) AS ret_20, round(llm_score, 6) AS llm_score FROM fit"))
def f2_rebalance_eligible(spark, sf_dir):
    scored = signals.attach_scores(all_features(spark, sf_dir), short_scores(spark, sf_dir))
    scored = strategy.with_history(scored, PICK.min_history)
    ends = month_ends(scored)
    fit = scored.join(ends, "date", "left_semi").where("eligible_universe and enough_history and ret_20 is not null and ret_60 is not null and vol_20 is not null")
    return fit.select("date", "ticker", r6(F.col("ret_20")).alias("ret_20"), r6(F.col("llm_score")).alias("llm_score"))


@query("t1_monthly_selection", with_tables("SELECT date, ticker, rank, round(score, 6) AS score, round(weight, 6) AS weight FROM chosen"))
def t1_monthly_selection(spark, sf_dir):
    ranked = strategy.rank_monthly(all_features(spark, sf_dir), PICK, short_scores(spark, sf_dir))
    return ranked.select("date", "ticker", "rank", r6(F.col("score")).alias("score"), rounded_to(F.col("weight"), 6).alias("weight"))


@query("q3_target_weights", with_tables("SELECT date, ticker, round(weight, 6) AS weight FROM weights"))
def q3_target_weights(spark, sf_dir):
    return rounded(weights(spark, sf_dir))


@query("m4_risk_limits", with_tables("SELECT date, ticker, round(weight, 6) AS weight FROM limited", carried="SELECT * FROM weights"))
def m4_risk_limits(spark, sf_dir):
    return rounded(strategy.limit_weights(weights(spark, sf_dir), 0.02, 0.04))


def momentum_sql() -> str:
    return with_tables(
        "SELECT date, ticker, round(ret_20_z, 6) AS ret_20_z, rank, round(1e0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM ("
        "SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret_20_z DESC, ticker) AS rank FROM ("
        f"SELECT date, ticker, {z('ret_20', 'date')} AS ret_20_z FROM price_feats WHERE date IN (SELECT date FROM ends) AND sma_20 IS NOT NULL AND ret_20 IS NOT NULL)) WHERE rank <= 4"
    )


@query("momentum_top4", momentum_sql())
def momentum_top4(spark, sf_dir):
    """Monthly four best suppliers by z-scored 20-row momentum, equally weighted."""
    prices = panel.prices(spark, sf_dir)
    frame = prices.withColumns({"ret_20": change(F.col("close"), 20), "sma_20": rolling(F.avg, F.col("close"), 20)})
    fit = frame.join(month_ends(prices), "date", "left_semi").where("sma_20 is not null and ret_20 is not null")
    scored = fit.withColumn("ret_20_z", zscore(F.col("ret_20"), Window.partitionBy("date")))
    return strategy.top_n(scored, "ret_20_z", 4).select("date", "ticker", r6(F.col("ret_20_z")).alias("ret_20_z"), "rank", rounded_to(F.col("weight"), 6).alias("weight"))


# --- backtest and metrics ------------------------------------------------


@query("w17_trades", with_tables("SELECT date, ticker, round(live, 6) AS live, round(change, 6) AS change, round(ret, 6) AS ret, round(liquidity, 5) AS liquidity FROM moves"))
def w17_trades(spark, sf_dir):
    moves = backtest.trades(panel.prices(spark, sf_dir), weights(spark, sf_dir), COSTS, 0.02, 0.04)
    return moves.select("date", "ticker", *[r6(F.col(c)).alias(c) for c in ("live", "change", "ret")], rounded_to(F.col("liquidity"), 5).alias("liquidity"))


_DAY = ("gross_return", "net_return", "turnover", "linear_cost", "spread_cost", "impact_cost", "max_participation", "benchmark_return")


@query("q15_backtest", with_tables(f"SELECT date, {', '.join(q6(c) for c in _DAY)} FROM bt"))
def q15_backtest(spark, sf_dir):
    return rounded(backtest_days(spark, sf_dir))


@query("w19_equity_drawdown", with_tables(f"SELECT date, {', '.join(q6(f'ln({c})', f'ln_{c}') for c in ('equity', 'gross_equity', 'benchmark_equity'))}, {q6('drawdown')} FROM drawn"))
def w19_equity_drawdown(spark, sf_dir):
    curves = metrics.with_curves(backtest_days(spark, sf_dir))
    return rounded(curves.select("date", *[F.ln(c).alias(f"ln_{c}") for c in ("equity", "gross_equity", "benchmark_equity")], "drawdown"))


@query("q17_value_curve", with_tables("SELECT date, round(ln(equity / first_value(equity) OVER (ORDER BY date) * 100000e0), 6) AS ln_portfolio_value, round(benchmark_equity / first_value(benchmark_equity) OVER (ORDER BY date) * 100000e0, 4) AS benchmark_value FROM curves"))
def q17_value_curve(spark, sf_dir):
    return metrics.value_curve(backtest_days(spark, sf_dir)).select("date", r6(F.ln("portfolio_value")).alias("ln_portfolio_value"), rounded_to(F.col("benchmark_value"), 4).alias("benchmark_value"))


_SUMMARY = """SELECT round(e - 1, 6) AS total_return, round(pow(e, 252e0 / n) - 1, 6) AS cagr, round(sd * sqrt(252e0), 6) AS annual_volatility, round(down * sqrt(252e0), 6) AS downside_volatility,
    round(mean / sd * sqrt(252e0), 6) AS sharpe, round(mean * 252e0 / (down * sqrt(252e0)), 6) AS sortino, round(dd, 6) AS max_drawdown, round((pow(e, 252e0 / n) - 1) / abs(dd), 6) AS calmar,
    round(turnover, 6) AS avg_daily_turnover, round(g - e, 6) AS cost_drag_total_return, round(lc + sc + ic, 6) AS avg_daily_total_cost, round(b - 1, 6) AS benchmark_total_return,
    round(e / b - 1, 6) AS excess_total_return, round(asd * sqrt(252e0), 6) AS tracking_error, round(am / asd * sqrt(252e0), 6) AS information_ratio
    FROM (SELECT max_by(equity, date) AS e, max_by(gross_equity, date) AS g, max_by(benchmark_equity, date) AS b, CAST(count(*) AS DOUBLE) AS n, avg(net_return) AS mean, stddev_pop(net_return) AS sd,
        sqrt(avg(pow(least(net_return, 0), 2))) AS down, min(drawdown) AS dd, avg(turnover) AS turnover, avg(linear_cost) AS lc, avg(spread_cost) AS sc, avg(impact_cost) AS ic,
        avg(net_return - benchmark_return) AS am, stddev_pop(net_return - benchmark_return) AS asd FROM drawn)"""


@query("a3_performance_summary", with_tables(_SUMMARY))
def a3_performance_summary(spark, sf_dir):
    columns = "total_return cagr annual_volatility downside_volatility sharpe sortino max_drawdown calmar avg_daily_turnover cost_drag_total_return avg_daily_total_cost benchmark_total_return excess_total_return tracking_error information_ratio"
    return rounded(metrics.summary(backtest_days(spark, sf_dir)).select(*columns.split()))


@query("w24_evaluation_windows", with_tables("SELECT row_number() OVER (ORDER BY start) AS \"window\", start, \"end\" FROM (SELECT k, min(date) AS start, max(date) AS \"end\", count(*) AS n FROM (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS b FROM (SELECT DISTINCT date FROM prices)), (SELECT unnest(range(4)) AS k) WHERE b >= k * 40 AND b < k * 40 + 52 GROUP BY k) WHERE n = 52"))
def w24_evaluation_windows(spark, sf_dir):
    return metrics.evaluation_windows(panel.prices(spark, sf_dir), 52, 40, 4)


@query("q16_window_evaluation", with_tables("SELECT min(date) AS eval_start, max(date) AS eval_end, count(*) AS n_days, round(max_by(e, date) - 1, 6) AS total_return, round(max_by(e, date) / min_by(e, date) * 100000e0, 4) AS ending_capital FROM (SELECT date, product(1 + net_return) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM bt WHERE date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31')"))
def q16_window_evaluation(spark, sf_dir):
    days = metrics.between(backtest_days(spark, sf_dir), "1999-01-01", "2000-12-31")
    row = metrics.evaluation_row(days, "rules").crossJoin(days.agg(F.count("*").alias("n_days")))
    return row.select("eval_start", "eval_end", "n_days", rounded_to(F.col("total_return"), 6).alias("total_return"), rounded_to(F.col("ending_capital"), 4).alias("ending_capital"))


@query("d3_business_days", with_tables("SELECT DISTINCT o_orderdate::DATE AS date, (CASE WHEN isodow(o_orderdate) >= 6 THEN o_orderdate::DATE + (8 - isodow(o_orderdate))::INT ELSE o_orderdate::DATE END - (9 + CASE WHEN 2 > (CASE WHEN isodow(o_orderdate) >= 6 THEN 0 ELSE isodow(o_orderdate) - 1 END) THEN 2 ELSE 0 END))::DATE AS cutoff FROM orders"))
def d3_business_days(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return panel.table(spark, sf_dir, "orders").select(d.alias("date"), minus_business_days(d, 7).alias("cutoff")).distinct()


@query("f12_keep_last", "SELECT o_custkey, o_orderdate::DATE AS last_date, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def f12_keep_last(spark, sf_dir):
    last = keep_last(panel.table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return last.select("o_custkey", F.to_date("o_orderdate").alias("last_date"), "o_orderkey", "o_totalprice")

