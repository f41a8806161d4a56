"""Comparisons of configurations, last-period reports, sweeps and their guidance texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import metrics
from quantloom.operators.research import hit_rate, signal_coverage


def require_same_data(configs: Mapping[str, Any]) -> None:
    """An error unless all configurations (data classes or dictionaries of market data settings) are equal."""
    plain = {k: v if isinstance(v, Mapping) else asdict(v) for k, v in configs.items()}
    first = next(iter(plain.values()), None)
    if differing := [k for k, v in plain.items() if v != first]:
        raise ValueError(f"configurations of other market data cannot be compared: {differing}")


def objective_name(quantile: Column) -> Column:
    """``raw`` without a quantile; else its percentage, to one place, as in clip_q97p5."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.1f", quantile * 100), r"0+$", ""), r"\.$", "")
    return F.when(quantile.isNull(), "raw").otherwise(F.concat(F.lit("clip_q"), F.replace(text, F.lit("."), F.lit("p"))))


def int_grid(text: str) -> list[int]:
    """Whole numbers between commas; none is an error."""
    out = [int(x) for x in (t.strip() for t in text.split(",")) if x]
    if not out:
        raise ValueError("at least one whole number is needed")
    return out


def optional_grid(text: str) -> list[float | None]:
    """Numbers between commas; none, null and raw stand for no number."""
    out = [None if x in ("none", "null", "raw") else float(x) for x in (t.strip().lower() for t in text.split(",")) if x]
    if not out:
        raise ValueError("at least one number or 'none' is needed")
    return out


def _by_config(frames: Mapping[str, DataFrame]) -> DataFrame:
    tagged = [f.withColumn("config_name", F.lit(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def changed_rebalances_by_config(histories: Mapping[str, DataFrame]) -> DataFrame:
    """(config_name, changed_rebalance_count): dates of both on which some weight differs from the first configuration's."""
    first = next(iter(histories))
    base = histories[first].select("date", "ticker", F.col("weight").alias("a"))
    own = _by_config({k: v.select("date", "ticker", F.col("weight").alias("b")) for k, v in histories.items()})
    names = own.select("config_name").distinct()
    both = own.select("config_name", "date").distinct().join(base.select("date").distinct(), "date", "left_semi")
    pairs = both.join(base, "date").select("config_name", "date", "ticker", "a", F.lit(0.0).alias("b"))
    mine = own.join(base.select("date").distinct(), "date", "left_semi").select("config_name", "date", "ticker", F.lit(0.0).alias("a"), "b")
    cell = pairs.unionByName(mine).groupBy("config_name", "date", "ticker").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    moved = cell.groupBy("config_name", "date").agg(F.bool_or(F.abs(F.col("a") - F.col("b")) > 1e-8 + 1e-5 * F.abs("b")).alias("changed"))
    counted = moved.groupBy("config_name").agg(F.count_if("changed").alias("changed_rebalance_count"))
    return names.join(counted, "config_name", "left").fillna(0, ["changed_rebalance_count"])


def compare_runs(days: Mapping[str, DataFrame], histories: Mapping[str, DataFrame], since: str | None = None, initial: float = 100_000.0) -> DataFrame:
    """One row for each configuration: the summary of its backtest, from ``since`` on if given, its signals and changed rebalances.

    ``days``: backtests by configuration; ``histories``: rows (date, ticker,
    weight, llm_score) of their rebalances. The first one is the base.
    """
    late = (lambda f: f) if since is None else (lambda f: f.where(F.col("date") >= F.to_date(F.lit(since))))
    ends = {k: metrics.value_curve(late(d), initial).agg(F.max_by("portfolio_value", "date").alias("ending_capital")) for k, d in days.items()}
    summaries = _by_config({k: metrics.summary(late(d)).join(ends[k], how="cross") for k, d in days.items()})
    signals = _by_config({k: signal_coverage(late(h)) for k, h in histories.items()})
    changed = changed_rebalances_by_config({k: late(h) for k, h in histories.items()})
    return summaries.join(signals, "config_name").join(changed, "config_name", "left")


def last_period(days: Mapping[str, DataFrame], lookback_days: int = 365, initial: float = 100_000.0) -> tuple[DataFrame, DataFrame]:
    """The last ``lookback_days`` days of each configuration: (comparison, best first; values by date, a column each).

    comparison: eval_start, eval_end, starting, ending capital and profit, the
    summary of the period, and the place by ending capital, then Sharpe ratio.
    """
    cut = {}
    for name, d in days.items():
        end = d.agg(F.date_sub(F.max("date"), lookback_days).alias("since"))
        cut[name] = d.join(F.broadcast(end), F.col("date") >= F.col("since")).drop("since")
    values = {k: metrics.value_curve(c, initial).select("date", "portfolio_value") for k, c in cut.items()}
    rows = _by_config({k: metrics.summary(c) for k, c in cut.items()})
    ends = _by_config({k: v.agg(F.min("date").alias("eval_start"), F.max("date").alias("eval_end"), F.max_by("portfolio_value", "date").alias("ending_capital")) for k, v in values.items()})
    out = rows.join(ends, "config_name").withColumns({"starting_capital": F.lit(float(initial)), "profit_dollars": F.col("ending_capital") - float(initial)})
    curves = _by_config(values).groupBy("date").pivot("config_name", sorted(days)).agg(F.max("portfolio_value"))
    return best_first(out), curves


def best_first(runs: DataFrame) -> DataFrame:
    """``runs``, one row a configuration, with their place by ending capital, then Sharpe ratio, then name."""
    best = Window.orderBy(F.col("ending_capital").desc_nulls_last(), F.col("sharpe").desc_nulls_last(), "config_name")
    return runs.withColumn("place", F.row_number().over(best))


def sweep_aggregate(windows: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Windows of sweep runs by model: mean and median capital, windows beaten, and each setting's first given value."""
    return windows.groupBy("model_name").agg(
        F.count_distinct("window_label").alias("window_count"),
        F.avg("ending_capital").alias("avg_ending_capital"),
        F.median("ending_capital").alias("median_ending_capital"),
        F.count_if("beat_baseline").alias("beat_baseline_windows"),
        *[F.first(c, ignorenulls=True).alias(c) for c in settings],
    )


def selected_means(history: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row: means over the selected rows of a ranking history, null where a column or a row is missing."""
    own = {k: F.avg(F.when(F.coalesce("selected", F.lit(False)), F.col(v))) if v in history.columns else F.lit(None).cast("double") for k, v in columns.items()}
    return history.agg(*[v.alias(k) for k, v in own.items()])


def combined(base: DataFrame, other: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``base`` with values of ``other`` where it has some: the other side wins, the base fills its gaps."""
    own = other.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(own, list(on), "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) if c in base.columns else F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def guidance_lines(board: DataFrame, most: int = 3) -> DataFrame:
    """(place, line): what a report says of the best models of a leaderboard, in order."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(F.col(c), 0))
    line = F.concat(
        F.lit("- `"), "model_name", F.lit("`: tier `"), "priority_tier", F.lit("`, average gap vs baseline `"), money("avg_gap"), F.lit("`, worst gap `"), money("worst_gap"),
        F.lit("`, beat rate `"), F.concat(F.format_string("%.0f", 100 * F.col("beat_rate")), F.lit("%")), F.lit("`."),
    )
    return board.where(F.col("rank") <= most).select(F.col("rank").alias("place"), line.alias("line"))


def tier_models(board: DataFrame) -> DataFrame:
    """(priority_tier, models): the models of each tier by rank, joined by commas."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("rank", "model_name"))), lambda x: x["model_name"])
    return board.groupBy("priority_tier").agg(F.array_join(own, ",").alias("models"))


def audit_rows(events: DataFrame, daily: DataFrame, start: str, end: str, capital: float, horizons: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """A row on the signals of each ticker with prices: span of prices, counts, mean score, confidence and risk, end values of holding and of the strategy, and by horizon correlation and hit rate.

    ``daily``: rows (ticker, date, close, portfolio_value) of the strategy, which began with ``capital``; tickers without a signal have counts of 0.
    """
    span = daily.groupBy("ticker").agg(
        F.min("date").alias("price_start_date"), F.max("date").alias("price_end_date"),
        F.max_by("portfolio_value", "date").alias("signal_strategy_end_capital"), (F.max_by("close", "date") / F.min_by("close", "date") * capital).alias("buy_hold_end_capital"),
    )
    score = F.col("llm_score")
    own: list[Column] = [F.count("*").alias("signal_event_count"), F.avg("llm_score").alias("avg_llm_score")]
    own += [(F.avg(c) if c in events.columns else F.lit(None).cast("double")).alias(c) for c in ("avg_confidence", "avg_risk_flag")]
    for h in horizons:
        r = F.col(f"forward_{h}d_return")
        both = r.isNotNull() & score.isNotNull()
        x, y = F.when(both, score), F.when(both, r)
        own.append(F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).alias(f"llm_forward_corr_{h}d"))
        own.append(hit_rate(score, r).alias(f"directional_hit_rate_{h}d"))
    out = span.join(events.groupBy("ticker").agg(*own), "ticker", "left").fillna(0, ["signal_event_count"])
    out = out.withColumns({"requested_start_date": F.lit(start), "requested_end_date": F.lit(end), "initial_capital": F.lit(float(capital))})
    return out.withColumns({f"{k}_total_return": F.col(f"{k}_end_capital") / float(capital) - 1 for k in ("signal_strategy", "buy_hold")})
