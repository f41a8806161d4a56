"""Event studies, signal strategies, router sets, learning frames and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import by_ticker, minus_business_days
from quantloom.operators.signals import asof_join, attach_scores
from quantloom.operators.strategy import with_history


def signal_events(scores: DataFrame, prices: DataFrame, horizons: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """Each score with the first trading date after it, that date's close and the returns over later rows.

    The next trading date is looked up backwards in time: from the dates' own
    shuffle by ticker, the row that follows the last one at or before the signal.
    """
    w = by_ticker()
    ahead = {f"forward_{h}d_date": F.lead("date", h + 1).over(w) for h in horizons}
    ahead |= {f"forward_{h}d_return": F.try_divide(F.lead("close", h + 1).over(w), F.lead("close", 1).over(w)) - 1 for h in horizons}
    steps = prices.select("ticker", "date", "close").withColumns({"trade_date": F.lead("date", 1).over(w), "trade_close": F.lead("close", 1).over(w), **ahead})
    # A signal before the first bar trades at the first bar.
    w_first = Window.partitionBy("ticker").orderBy("date")
    first = prices.select("ticker", "date", "close", *[F.lead("date", h).over(w_first).alias(f"forward_{h}d_date") for h in horizons], *[(F.try_divide(F.lead("close", h).over(w_first), F.col("close")) - 1).alias(f"forward_{h}d_return") for h in horizons], F.row_number().over(w_first).alias("__n")).where("__n = 1")
    before = first.select("ticker", F.lit("0001-01-01").cast("date").alias("date"), F.lit(None).cast("double").alias("close"), F.col("date").alias("trade_date"), F.col("close").alias("trade_close"), *ahead)
    columns = ["trade_date", "trade_close", *ahead]
    out = asof_join(scores, steps.unionByName(before), ["ticker"], columns)
    return out.withColumnRenamed("date", "signal_date").withColumn("days_until_trade", F.datediff("trade_date", "signal_date"))


def signal_strategy(prices: DataFrame, events: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Daily positions of one score: from its trade date to the next event's, live a row later; long positive scores only."""
    known = events.where("trade_date is not null").select("ticker", F.col("trade_date").alias("date"), "signal_date", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("llm_score"))).alias("target"))
    at = asof_join(prices.select("ticker", "date", "close"), known, ["ticker"], ["target"], tie=(F.col("signal_date"),))
    w = by_ticker()
    out = at.withColumn("target_position", F.coalesce("target", F.lit(0.0))).drop("target")
    out = out.withColumns({"live_position": F.lag("target_position", 1, 0.0).over(w), "asset_return": F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))})
    out = out.withColumn("strategy_return", F.col("live_position") * F.col("asset_return"))
    grown = F.product(1 + F.col("strategy_return")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("portfolio_value", grown * capital)


def hit_rate(score: Column, outcome: Column) -> Column:
    """How often outcome and score have one sign, of rows that have both and a score other than 0."""
    both = outcome.isNotNull() & score.isNotNull() & (score != 0)
    return F.avg(F.when(both, (F.signum(outcome) == F.signum(score)).cast("double")))


def audit_summary(events: DataFrame, horizon: int) -> DataFrame:
    """By ticker: events, hit rate of the score's sign, correlation with the return and mean return."""
    r, s = F.col(f"forward_{horizon}d_return"), F.col("llm_score")
    both = r.isNotNull() & s.isNotNull()
    n = F.count_if(both)
    return events.groupBy("ticker").agg(
        F.count("*").alias("events"),
        n.alias("with_return"),
        hit_rate(s, r).alias("hit_rate"),
        F.when((n >= 2) & (F.stddev_pop(F.when(both, r)) > 0) & (F.stddev_pop(F.when(both, s)) > 0), F.corr(F.when(both, s), F.when(both, r))).alias("correlation"),
        F.avg(F.when(both, r)).alias("mean_return"),
    )


#: What a router row tells of the prices, by name in sorted order.
ROUTER_FEATURES = ("benchmark_ret_20", "benchmark_vol_20", "market_trend_ok", "price_vs_sma50", "rel_ret_20", "rel_ret_60", "ret_1", "ret_20", "ret_5", "ret_60", "trend_ok", "vol_20", "vol_60")


def best_horizon(short: Column, swing: Column, long: Column) -> Column:
    """The name of the largest return; ties go to the first, all null to an empty text."""
    top = F.greatest(short, swing, long)
    return F.when(top.isNull(), "").when(short == top, "short_term").when(swing == top, "swing").otherwise("long_term")


def router_frame(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Each score with the features at or before it as JSON, the returns that followed and the best horizon."""
    w = by_ticker()
    ahead = {f"next_{h}d_return": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1 for h in (5, 20, 60)}
    missing = {c: F.lit(None).cast("double") for c in ROUTER_FEATURES if c not in features.columns}
    facts = features.withColumns({**ahead, **missing})
    known = scores if "horizon_bucket" in scores.columns else scores.withColumn("horizon_bucket", F.lit("swing"))
    known = known.join(features.select("ticker").distinct(), "ticker", "left_semi")
    out = asof_join(known.select("date", "ticker", "horizon_bucket", "llm_score"), facts, ["ticker"], [*ROUTER_FEATURES, *ahead])
    as_json = F.to_json(F.struct(*ROUTER_FEATURES), {"ignoreNullFields": "false"})
    label = best_horizon(*[F.col(f"next_{h}d_return") for h in (5, 20, 60)])
    return out.select("date", "ticker", "horizon_bucket", "llm_score", as_json.alias("price_features"), *ahead, label.alias("best_realized_horizon_label"))


@dataclass(frozen=True)
class WalkForward:
    horizon: int = 20
    validation_dates: int = 60
    embargo: int | None = None
    min_training: int = 252
    min_validation: int = 120
    columns: tuple[str, ...] = ("ret_5", "ret_20", "ret_60", "rel_ret_20", "vol_20", "vol_60", "drawdown_20", "volume_ratio_20", "range_pct_20", "cs_ret_20_z", "universe_momentum_rank_pct", "sector_ret_20_gap")

    @property
    def embargo_days(self) -> int:
        return self.horizon if self.embargo is None else self.embargo


def forward_labels(frame: DataFrame, horizon: int) -> DataFrame:
    """``frame`` with the return over the next ``horizon`` rows of its ticker and the date on which it is known; null where there are fewer."""
    w = by_ticker()
    return frame.withColumns({"future_return": F.try_divide(F.lead("close", horizon).over(w), F.col("close")) - 1, "label_available_date": F.lead("date", horizon).over(w)})


def live_candidates(frame: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of a learning frame on the dates that a model could rank: eligible, with history and all model columns."""
    return frame.join(dates.select("date"), "date", "left_semi").where("eligible_universe and enough_history and has_model_features")


def learning_frame(features: DataFrame, config: WalkForward, min_history: int, scores: DataFrame | None = None) -> DataFrame:
    """Features with the forward label, when it is known, and the flags of usable rows."""
    out = attach_scores(features, scores) if scores is not None else features.withColumn("llm_score", F.lit(0.0))
    out = forward_labels(with_history(out, min_history), config.horizon)
    flags = {"trend_flag": "trend_ok", "market_trend_flag": "market_trend_ok", "market_high_vol_flag": "market_high_vol_regime"}
    out = out.withColumns({k: F.coalesce(F.col(v), F.lit(False)).cast("double") for k, v in flags.items() if v in out.columns})
    known = F.lit(True)
    for c in config.columns:
        known = known & F.col(c).isNotNull()
    eligible = F.coalesce("eligible_universe", F.lit(True)) if "eligible_universe" in out.columns else F.lit(True)
    return out.withColumns({"eligible_universe": eligible, "has_model_features": known, "has_training_label": F.col("future_return").isNotNull() & F.col("label_available_date").isNotNull()})


def split_bounds(frame: DataFrame, dates: DataFrame, config: WalkForward) -> DataFrame:
    """(rebalance_date, cutoff, validation_start, training_rows, validation_rows, usable) for each rebalance date.

    Rows are counted by date first, so what is joined to the rebalance dates is
    one row a date and not the history.
    """
    usable = frame.where("eligible_universe and enough_history and has_model_features and has_training_label")
    counts = usable.groupBy("date", "label_available_date").agg(F.count("*").alias("n"))
    asked = dates.select(F.col("date").alias("rebalance_date"), minus_business_days(F.col("date"), config.embargo_days).alias("cutoff"))
    past = F.broadcast(asked).join(counts, F.col("label_available_date") < F.col("cutoff")).groupBy("rebalance_date", "cutoff", "date").agg(F.sum("n").alias("n"))
    back = Window.partitionBy("rebalance_date").orderBy(F.col("date").desc())
    ranked = past.withColumn("back", F.row_number().over(back))
    late = F.col("back") <= config.validation_dates
    out = ranked.groupBy("rebalance_date", "cutoff").agg(
        F.min(F.when(late, F.col("date"))).alias("validation_start"),
        F.coalesce(F.sum(F.when(~late, F.col("n"))), F.lit(0)).alias("training_rows"),
        F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)).alias("validation_rows"),
        F.count("*").alias("dates"),
    )
    enough = (F.col("dates") > config.validation_dates) & (F.col("training_rows") >= config.min_training) & (F.col("validation_rows") >= config.min_validation)
    return out.withColumn("usable", enough).drop("dates")


def stability(windows: DataFrame, baseline: str) -> tuple[DataFrame, DataFrame]:
    """Window rows with the gap to the baseline model, and their aggregate by model."""
    base = F.max(F.when(F.col("model_name") == baseline, F.col("ending_capital"))).over(Window.partitionBy("window_label"))
    rows = windows.withColumn("ending_capital_gap_vs_baseline", F.col("ending_capital") - base).withColumn("beat_baseline", F.col("ending_capital") > base)
    gap = F.col("ending_capital_gap_vs_baseline")
    by_model = rows.groupBy("model_name").agg(
        F.count_distinct("window_label").alias("window_count"),
        F.avg("ending_capital").alias("avg_ending_capital"),
        F.median("ending_capital").alias("median_ending_capital"),
        F.avg(gap).alias("avg_gap"),
        F.median(gap).alias("median_gap"),
        F.min(gap).alias("worst_gap"),
        F.max(gap).alias("best_gap"),
        F.stddev_pop(gap).alias("gap_std"),
        F.avg(F.col("beat_baseline").cast("double")).alias("beat_rate"),
        F.count_if("beat_baseline").alias("windows_beaten"),
    )
    return rows, by_model


def leaderboard(rows: DataFrame, by_model: DataFrame, last_year: DataFrame) -> DataFrame:
    """The aggregate with the latest window's and last year's gaps, the tier and the rank.

    ``last_year``: model_name and latest_report_gap.
    """
    end = rows.agg(F.max("eval_end").alias("eval_end"))
    latest = rows.join(F.broadcast(end), "eval_end").select("model_name", F.col("ending_capital_gap_vs_baseline").alias("latest_gap"))
    out = by_model.join(latest, "model_name", "left").join(last_year, "model_name", "left")
    tier = (
        F.when((F.col("avg_gap") > 0) & (F.col("beat_rate") >= 0.5), "promote")
        .when((F.col("latest_gap") > 0) | (F.col("latest_report_gap") > 0), "challenger")
        .otherwise("deprioritize")
    )
    out = out.withColumns(
        {
            "degradation": F.col("latest_gap") - F.col("avg_gap"),
            "robust_positive_windows": (F.col("beat_rate") >= 0.5) & (F.col("worst_gap") > -5000.0),
            "priority_tier": tier,
        }
    )
    order = [F.col(c).desc_nulls_last() for c in ("avg_gap", "worst_gap", "beat_rate", "latest_report_gap")]
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order, "model_name")))


def changed_rebalances(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: rebalance dates of both on which some weight differs by more than 1e-8 + 1e-5 of the candidate's."""
    dates = base.select("date").distinct().join(candidate.select("date").distinct(), "date", "left_semi")
    both = base.select("date", "ticker", F.col("weight").alias("a")).join(candidate.select("date", "ticker", F.col("weight").alias("b")), ["date", "ticker"], "full").fillna(0.0, ["a", "b"])
    moved = both.join(dates, "date", "left_semi").groupBy("date").agg(F.bool_or(F.abs(F.col("a") - F.col("b")) > 1e-8 + 1e-5 * F.abs("b")).alias("changed"))
    return moved.agg(F.count_if("changed").alias("changed_rebalance_count"), F.count("*").alias("compared_dates"))


def signal_coverage(frame: DataFrame) -> DataFrame:
    return frame.agg(F.avg((F.abs("llm_score") > 0).cast("double")).alias("coverage"), F.avg(F.abs("llm_score")).alias("mean_abs_score"))
