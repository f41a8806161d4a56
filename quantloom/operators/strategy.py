"""Monthly selection of names, and the weights that follow from it. Weights stay long: (date, ticker, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import forward_fill, month_ends, zscore
from quantloom.operators.signals import attach_scores


@dataclass(frozen=True)
class Rules:
    top_n: int = 4
    min_history: int = 200
    trend_mode: str = "hard"
    trend_penalty: float = 0.35
    momentum_20_weight: float = 0.45
    momentum_60_weight: float = 0.35
    volatility_weight: float = -0.20
    llm_weight: float = 0.0
    hold_between_rebalances: bool = True
    rebalance: str = "monthly"

    def __post_init__(self) -> None:
        if self.trend_mode not in ("hard", "soft"):
            raise ValueError(f"unknown trend mode {self.trend_mode}")
        if self.rebalance != "monthly":
            raise ValueError(f"unknown rebalance rule {self.rebalance}")


def with_history(frame: DataFrame, min_history: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return frame.withColumn("enough_history", nth >= min_history)


def _trend(frame: DataFrame, rules: Rules) -> DataFrame:
    return frame.where("trend_ok") if rules.trend_mode == "hard" else frame


def top_n(frame: DataFrame, score: str, n: int, ties: tuple[Column, ...] = ()) -> DataFrame:
    """The n best rows of each date by score, then ticker, each with weight 1 / rows chosen."""
    best = Window.partitionBy("date").orderBy(F.col(score).desc_nulls_last(), *ties, F.col("ticker"))
    chosen = frame.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return chosen.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("date")))


def rank_monthly(features: DataFrame, rules: Rules = Rules(), scores: DataFrame | None = None) -> DataFrame:
    """(date, ticker, score, rank, weight) of the names chosen on each month's last date."""
    scored = attach_scores(features, scores) if scores is not None else features.withColumn("llm_score", F.lit(0.0))
    scored = with_history(scored, rules.min_history)
    if "eligible_universe" not in scored.columns:
        scored = scored.withColumn("eligible_universe", F.lit(True))
    fit = scored.join(month_ends(features), "date", "left_semi").where(
        "coalesce(eligible_universe, false) and enough_history and ret_20 is not null and ret_60 is not null and vol_20 is not null"
    )
    fit = _trend(fit, rules)
    day = Window.partitionBy("date")
    score = (
        zscore(F.col("ret_20"), day) * rules.momentum_20_weight
        + zscore(F.col("ret_60"), day) * rules.momentum_60_weight
        + zscore(F.col("vol_20"), day) * rules.volatility_weight
        + zscore(F.col("llm_score"), day) * rules.llm_weight
    )
    if rules.trend_mode == "soft":
        score = score - (~F.col("trend_ok")).cast("double") * rules.trend_penalty
    return top_n(fit.withColumn("score", score), "score", rules.top_n).select("date", "ticker", "score", "rank", "weight")


def weigh_predictions(predicted: DataFrame, rules: Rules = Rules(trend_mode="soft")) -> DataFrame:
    """``predicted`` (date, ticker, predicted_return) with the rank on its date and the weight, 0 beyond the best ``top_n``.

    Where there is a column trend_ok, rows without a trend go in hard mode and
    are ranked lower by the penalty in soft mode.
    """
    score = F.col("predicted_return")
    if "trend_ok" in predicted.columns:
        predicted = _trend(predicted, rules)
        score = score - (~F.col("trend_ok")).cast("double") * rules.trend_penalty if rules.trend_mode == "soft" else score
    best = Window.partitionBy("date").orderBy(score.desc_nulls_last(), "ticker")
    ranked = predicted.withColumn("rank", F.row_number().over(best))
    chosen = F.least(F.lit(rules.top_n), F.count("*").over(Window.partitionBy("date")))
    return ranked.withColumn("weight", F.when(F.col("rank") <= rules.top_n, 1.0 / chosen).otherwise(0.0))


def spine(frame: DataFrame) -> DataFrame:
    """Every date with every ticker of the frame. Dates are few and fixed by the calendar, so they are the side that is copied."""
    return frame.select("ticker").distinct().crossJoin(F.broadcast(frame.select("date").distinct()))


def hold(chosen: DataFrame, features: DataFrame, hold_between: bool = True) -> DataFrame:
    """Weights on every date of the frame: set on each rebalance date, kept until the next.

    On a rebalance date names that are not chosen get 0, also when none is
    chosen. Without ``hold_between`` weights last for that date only.
    """
    ends = month_ends(features).withColumn("__end", F.lit(True))
    grid = spine(features).join(F.broadcast(ends), "date", "left").join(chosen.select("date", "ticker", "weight"), ["date", "ticker"], "left")
    at_end = F.when(F.col("__end"), F.coalesce("weight", F.lit(0.0)))
    kept = forward_fill(at_end) if hold_between else at_end
    return grid.select("date", "ticker", F.coalesce(kept, F.lit(0.0)).alias("weight"))


def target_weights(features: DataFrame, rules: Rules = Rules(), scores: DataFrame | None = None) -> DataFrame:
    """(date, ticker, weight) for every date and ticker of the features."""
    return hold(rank_monthly(features, rules, scores), features, rules.hold_between_rebalances)


def limit_weights(weights: DataFrame, cap: float, cash_buffer: float) -> DataFrame:
    """Weights cut to [0, cap] and scaled down where a date's sum exceeds 1 - cash_buffer."""
    cut = weights.withColumn("weight", F.least(F.lit(cap), F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0)))))
    total, room = F.sum("weight").over(Window.partitionBy("date")), F.lit(max(0.0, 1.0 - cash_buffer))
    return cut.withColumn("weight", F.when(total > room, F.col("weight") * room / total).otherwise(F.col("weight")))


def wide_weights(weights: DataFrame, tickers: tuple[str, ...]) -> DataFrame:
    """A row a date with a column for each of the named tickers; 0 where a name has no weight."""
    return weights.groupBy("date").pivot("ticker", list(tickers)).agg(F.max("weight")).fillna(0.0)
