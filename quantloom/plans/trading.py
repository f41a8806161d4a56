"""Queries of portfolio, broker, audit, router, walk-forward and report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import r6, rounded_to
from quantloom.operators import broker, metrics, models, portfolio, research, strategy
from quantloom.plans.research import (
    PICK,
    all_features,
    backtest_days,
    query,
    rounded,
    short_scores,
    weights,
)
from quantloom.plans.research import ORACLE_SQL as _PARENT_SQL
from quantloom.plans.research import QUERIES as _PARENT
from quantloom.plans.sql import with_tables
from quantloom.shared import stage_table
from quantloom.sources import panel

_BEFORE = set(_PARENT)
AS_OF = "2000-06-30"
RISK = portfolio.Risk(capital_base=1_000_000.0, cash_buffer=0.05, max_position_weight=0.20, min_trade_notional=250.0)


def _portfolio(spark, sf_dir) -> DataFrame:
    prices = panel.prices(spark, sf_dir)
    # Weights stand on every date; only those of names that trade on the date can be priced.
    held = weights(spark, sf_dir).join(prices.select("date", "ticker"), ["date", "ticker"], "left_semi")
    return portfolio.target_portfolio(held, prices, RISK, AS_OF)


def _positions(spark, sf_dir) -> DataFrame:
    """Invented holdings of every supplier."""
    key = F.substring("ticker", 2, 20).cast("int")
    return panel.metadata(spark, sf_dir).select("ticker", (key % 50 + 10).cast("double").alias("shares"))


_TABLES = {
    "port_raw": f"SELECT w.date, w.ticker, w.weight, p.close FROM weights w JOIN prices p ON p.date = w.date AND p.ticker = w.ticker WHERE w.date = (SELECT max(w.date) FROM weights w JOIN prices p ON p.date = w.date AND p.ticker = w.ticker WHERE w.date <= DATE '{AS_OF}') AND w.weight > 0",
    "port": """SELECT date, ticker, weight AS raw_weight, target_weight, close, target_weight * 1e6 AS target_notional, floor(target_weight * 1e6 / close) AS target_shares,
        floor(target_weight * 1e6 / close) * close AS target_notional_after_rounding FROM (
        SELECT *, CASE WHEN total > 0.95e0 THEN cut * 0.95e0 / total ELSE cut END AS target_weight FROM (
            SELECT *, least(0.20e0, weight) AS cut, sum(least(0.20e0, weight)) OVER () AS total FROM port_raw))""",
    "held": "SELECT ticker, CAST(substr(ticker, 2)::INT % 50 + 10 AS DOUBLE) AS shares FROM metadata",
    "lastp": f"SELECT ticker, max_by(close, date) AS close FROM prices WHERE date <= DATE '{AS_OF}' GROUP BY ticker",
    "ord": """SELECT date, ticker, CASE WHEN n > 0 THEN 'BUY' ELSE 'SELL' END AS side, n AS order_shares, close, abs(n) * close AS trade_notional, target_weight, tn AS target_notional_after_rounding FROM (
        SELECT (SELECT max(date) FROM port) AS date, coalesce(h.ticker, t.ticker) AS ticker, coalesce(t.target_shares, 0) - coalesce(h.shares, 0) AS n, coalesce(t.close, l.close, 0) AS close,
            coalesce(t.target_weight, 0) AS target_weight, coalesce(t.target_notional_after_rounding, 0) AS tn
        FROM held h FULL JOIN port t ON h.ticker = t.ticker LEFT JOIN lastp l ON l.ticker = coalesce(h.ticker, t.ticker)) WHERE n <> 0 AND abs(n) * close >= 250""",
    # Each order twice: as it is, and once more for half of it. Sells come first, so what a second sell may take is what the first left.
    "twice": "SELECT *, 1 AS seq, abs(order_shares) AS requested FROM ord UNION ALL SELECT *, 2, ceil(abs(order_shares) / 2) FROM ord",
    "queue": """SELECT row_number() OVER (ORDER BY CASE WHEN side = 'SELL' THEN 0 ELSE 1 END, o.ticker, seq) AS rank, o.ticker, o.side, requested, coalesce(l.close, 0) AS price,
        CASE WHEN side = 'SELL' THEN greatest(0, coalesce(h.shares, 0) - CASE WHEN seq = 2 THEN abs(order_shares) ELSE 0 END) END AS have
        FROM twice o LEFT JOIN held h ON h.ticker = o.ticker LEFT JOIN lastp l ON l.ticker = o.ticker""",
    "path": """SELECT CAST(0 AS BIGINT) AS rank, '' AS ticker, '' AS side, 0e0 AS requested, 0e0 AS filled, 0e0 AS price, 200000e0 AS cash
        UNION ALL SELECT rank, ticker, side, requested, filled, price, cash + CASE WHEN side = 'SELL' THEN filled * price * (1 - 0.001e0) ELSE -(filled * price) * (1 + 0.001e0) END FROM (
            SELECT q.rank, q.ticker, q.side, q.requested, q.price, p.cash,
                greatest(0, floor(least(q.requested, CASE WHEN q.side = 'SELL' THEN q.have ELSE greatest(0, p.cash / (q.price * (1 + 0.001e0))) END) + 1e-12)) AS filled
            FROM path p JOIN queue q ON q.rank = p.rank + 1)""",
}


def _orders(spark, sf_dir) -> DataFrame:
    latest = portfolio.latest_prices(panel.prices(spark, sf_dir), AS_OF)
    return portfolio.rebalance_orders(_portfolio(spark, sf_dir), _positions(spark, sf_dir), RISK, latest)


_PORT = "date, ticker, round(raw_weight, 6) AS raw_weight, round(target_weight, 6) AS target_weight, round(close, 5) AS close, round(target_notional, 4) AS target_notional, target_shares, round(target_notional_after_rounding, 4) AS target_notional_after_rounding"
_Q18 = with_tables(f"SELECT {_PORT} FROM port", **{k: v for k, v in _TABLES.items() if k != "path"})


@query("q18_target_portfolio", _Q18)
def q18_target_portfolio(spark, sf_dir):
    p = _portfolio(spark, sf_dir)
    places = {"raw_weight": 6, "target_weight": 6, "close": 5, "target_notional": 4, "target_notional_after_rounding": 4}
    return p.select(*[rounded_to(F.col(c), places[c]).alias(c) if c in places else F.col(c) for c in p.columns])


# The weights' own recursive table is not part of these oracles, so the fold may use its name.
@query("q19_rebalance_orders", with_tables("SELECT date, ticker, side, order_shares, round(close, 5) AS close, round(trade_notional, 4) AS trade_notional, round(target_weight, 6) AS target_weight FROM ord", **{k: v for k, v in _TABLES.items() if k != "path"}))
def q19_rebalance_orders(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("date", "ticker", "side", "order_shares", rounded_to(F.col("close"), 5).alias("close"), rounded_to(F.col("trade_notional"), 4).alias("trade_notional"), r6(F.col("target_weight")).alias("target_weight"))


@query("q26_paper_broker_fills", with_tables("SELECT rank, ticker, side, requested AS requested_shares, filled AS filled_shares, requested - filled AS remaining_shares, round(cash, 4) AS cash_after, CASE WHEN filled <= 0 THEN 'REJECTED' WHEN filled >= requested THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS status FROM path WHERE rank > 0", **_TABLES))
def q26_paper_broker_fills(spark, sf_dir):
    orders, _ = stage_table(_orders(spark, sf_dir), "orders")
    both = orders.withColumn("seq", F.lit(1)).unionByName(orders.withColumns({"seq": F.lit(2), "order_shares": F.ceil(F.abs("order_shares") / 2).cast("double") * F.signum("order_shares")}))
    # Without a close of its own, an order takes the latest one.
    latest = portfolio.latest_prices(panel.prices(spark, sf_dir), AS_OF)
    fills = broker.fill_orders(both.withColumn("close", F.lit(0.0)), _positions(spark, sf_dir), 200_000.0, fee_bps=10, latest=latest)
    return fills.select(F.col("rank").cast("long").alias("rank"), "ticker", "side", "requested_shares", "filled_shares", "remaining_shares", rounded_to(F.col("cash_after"), 4).alias("cash_after"), "status")


@query("q20_next_positions", with_tables("SELECT ticker, target_shares AS shares FROM port", **{k: v for k, v in _TABLES.items() if k != "path"}))
def q20_next_positions(spark, sf_dir):
    return portfolio.next_positions(_portfolio(spark, sf_dir))


@query("q30_reconcile", with_tables("""SELECT ticker, shares AS expected_shares, shares + CASE WHEN substr(ticker, 2)::INT % 5 = 0 THEN 1 ELSE 0 END AS actual_shares, CASE WHEN substr(ticker, 2)::INT % 5 = 0 THEN 1e0 ELSE 0e0 END AS share_delta,
    CASE WHEN substr(ticker, 2)::INT % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM held UNION ALL SELECT 'NEW', 0, 3, 3, 'mismatch'""", held=_TABLES["held"]))
def q30_reconcile(spark, sf_dir):
    """Every holding against an account that holds a share more of some names, and one name more."""
    key = F.substring("ticker", 2, 20).cast("int")
    actual = _positions(spark, sf_dir).withColumn("shares", F.col("shares") + F.when(key % 5 == 0, 1.0).otherwise(0.0))
    return portfolio.reconcile(_positions(spark, sf_dir), actual.unionByName(spark.createDataFrame([("NEW", 3.0)], "ticker string, shares double")))


@query("q28_guardrails", with_tables("SELECT count(*) AS order_count, round(sum(trade_notional), 3) AS total_notional, round(max(trade_notional), 3) AS largest_notional, count(*) <= 50 AND sum(trade_notional) <= 5e5 AND max(trade_notional) <= 3e5 AS allowed FROM ord", **{k: v for k, v in _TABLES.items() if k != "path"}))
def q28_guardrails(spark, sf_dir):
    g = portfolio.guardrails(_orders(spark, sf_dir), 50, 5e5, 3e5)
    return g.select("order_count", rounded_to(F.col("total_notional"), 3).alias("total_notional"), rounded_to(F.col("largest_notional"), 3).alias("largest_notional"), "allowed")


@query("a15_latest_prices", with_tables("SELECT ticker, round(close, 5) AS close FROM lastp", lastp=_TABLES["lastp"]))
def a15_latest_prices(spark, sf_dir):
    return portfolio.latest_prices(panel.prices(spark, sf_dir), AS_OF).select("ticker", rounded_to(F.col("close"), 5).alias("close"))


@query("a17_positions_value", with_tables("SELECT round(sum(shares * close), 3) AS positions_value FROM held JOIN lastp USING (ticker)", held=_TABLES["held"], lastp=_TABLES["lastp"]))
def a17_positions_value(spark, sf_dir):
    v = portfolio.positions_value(_positions(spark, sf_dir), portfolio.latest_prices(panel.prices(spark, sf_dir), AS_OF))
    return v.select(rounded_to(F.col("positions_value"), 3).alias("positions_value"))


@query("a16_portfolio_summary", with_tables("SELECT (SELECT count(*) FROM port) AS holdings, (SELECT round(sum(target_weight), 6) FROM port) AS total_weight, (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM port) AS tickers, count(*) AS orders, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells FROM ord", **{k: v for k, v in _TABLES.items() if k != "path"}))
def a16_portfolio_summary(spark, sf_dir):
    s = portfolio.portfolio_summary(_portfolio(spark, sf_dir), _orders(spark, sf_dir))
    return s.select("holdings", r6(F.col("total_weight")).alias("total_weight"), "tickers", "orders", "buys", "sells")


# --- audit and router ------------------------------------------------------

_EVENTS = {
    "numbered": "SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM prices",
    "events_of": """SELECT s.ticker, s.date AS signal_date, s.llm_score, s.document_count, (SELECT min(k) FROM numbered n WHERE n.ticker = s.ticker AND n.date > s.date) AS k
        FROM signals s WHERE horizon_bucket = 'short'""",
    "ev": """SELECT e.ticker, e.signal_date, e.llm_score, e.document_count, a.date AS trade_date, a.close AS trade_close, date_diff('day', e.signal_date, a.date) AS days_until_trade,
        b.date AS forward_5d_date, b.close / a.close - 1 AS forward_5d_return FROM events_of e
        LEFT JOIN numbered a ON a.ticker = e.ticker AND a.k = e.k LEFT JOIN numbered b ON b.ticker = e.ticker AND b.k = e.k + 5""",
}


def _events(spark, sf_dir) -> DataFrame:
    return research.signal_events(short_scores(spark, sf_dir), panel.prices(spark, sf_dir), (5,))


@query("q21_signal_events", with_tables("SELECT ticker, signal_date, llm_score, document_count, trade_date, round(trade_close, 5) AS trade_close, CAST(days_until_trade AS INT) AS days_until_trade, forward_5d_date, round(forward_5d_return, 6) AS forward_5d_return FROM ev", **_EVENTS))
def q21_signal_events(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("ticker", "signal_date", "llm_score", "document_count", "trade_date", rounded_to(F.col("trade_close"), 5).alias("trade_close"), "days_until_trade", "forward_5d_date", r6(F.col("forward_5d_return")).alias("forward_5d_return"))


@query("a14_signal_audit", with_tables("SELECT ticker, count(*) AS events, count(forward_5d_return) AS with_return, round(avg(CASE WHEN forward_5d_return IS NOT NULL AND llm_score <> 0 THEN CAST(sign(forward_5d_return) = sign(llm_score) AS DOUBLE) END), 6) AS hit_rate, round(avg(forward_5d_return), 6) AS mean_return, round(corr(llm_score, forward_5d_return), 6) AS correlation FROM ev GROUP BY ticker", **_EVENTS))
def a14_signal_audit(spark, sf_dir):
    return rounded(research.audit_summary(_events(spark, sf_dir), 5))


@query("q22_signal_strategy", with_tables("""SELECT ticker, date, round(target_position, 6) AS target_position, round(live, 6) AS live_position, round(r, 6) AS asset_return, round(live * r, 6) AS strategy_return FROM (
    SELECT *, lag(target_position, 1, 0) OVER (PARTITION BY ticker ORDER BY date) AS live, coalesce(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 0) AS r FROM (
        SELECT p.ticker, p.date, p.close, CASE WHEN e.llm_score IS NULL THEN 0 ELSE greatest(0, least(1, e.llm_score)) END AS target_position FROM prices p ASOF LEFT JOIN (
            SELECT ticker, trade_date, max_by(llm_score, signal_date) AS llm_score FROM ev WHERE trade_date IS NOT NULL GROUP BY ticker, trade_date) e ON e.ticker = p.ticker AND p.date >= e.trade_date))""", **_EVENTS))
def q22_signal_strategy(spark, sf_dir):
    s = research.signal_strategy(panel.prices(spark, sf_dir), _events(spark, sf_dir))
    return rounded(s.select("ticker", "date", "target_position", "live_position", "asset_return", "strategy_return"))


@query("q23_router_frame", with_tables("""SELECT s.date, s.ticker, s.horizon_bucket, s.llm_score, round(n5, 6) AS next_5d_return, round(n20, 6) AS next_20d_return, round(n60, 6) AS next_60d_return,
    CASE WHEN coalesce(n5, n20, n60) IS NULL THEN '' WHEN n5 = greatest(n5, n20, n60) THEN 'short_term' WHEN n20 = greatest(n5, n20, n60) THEN 'swing' ELSE 'long_term' END AS best_realized_horizon_label, round(f.ret_20, 6) AS ret_20
    FROM (SELECT * FROM signals WHERE ticker IN (SELECT ticker FROM prices)) s ASOF LEFT JOIN (SELECT *, lead(close, 5) OVER w / close - 1 AS n5, lead(close, 20) OVER w / close - 1 AS n20, lead(close, 60) OVER w / close - 1 AS n60
        FROM price_feats WINDOW w AS (PARTITION BY ticker ORDER BY date)) f ON f.ticker = s.ticker AND s.date >= f.date"""))
def q23_router_frame(spark, sf_dir):
    from quantloom.operators import features

    out = research.router_frame(features.price_features(panel.prices(spark, sf_dir)), panel.signals(spark, sf_dir))
    got = F.get_json_object("price_features", "$.ret_20").cast("double")
    return rounded(out.withColumn("ret_20", got).drop("price_features"))


# --- walk-forward ----------------------------------------------------------

CONFIG = research.WalkForward(horizon=4, validation_dates=20, min_training=100, min_validation=40)
_LEARN = {
    "learn": f"""SELECT *, close4 / nullif(close, 0) - 1 AS future_return, row_number() OVER (PARTITION BY ticker ORDER BY date) >= 20 AS enough_history,
        {" AND ".join(f"{c} IS NOT NULL" for c in CONFIG.columns)} AS has_model_features FROM (
        SELECT *, lead(close, 4) OVER (PARTITION BY ticker ORDER BY date) AS close4, lead(date, 4) OVER (PARTITION BY ticker ORDER BY date) AS label_available_date FROM feats)""",
    "usable_rows": "SELECT date, label_available_date, ticker, future_return FROM learn WHERE eligible_universe AND enough_history AND has_model_features AND future_return IS NOT NULL AND label_available_date IS NOT NULL",
    "asked": """SELECT date AS rebalance_date, CAST(date - 4 - CASE WHEN 4 > isodow(date) - 1 THEN 2 ELSE 0 END AS DATE) AS cutoff FROM (
        SELECT max(date) AS date FROM feats GROUP BY date_trunc('month', date))""",
    "past": "SELECT rebalance_date, cutoff, date, count(*) AS n, row_number() OVER (PARTITION BY rebalance_date ORDER BY date DESC) AS back FROM asked JOIN usable_rows ON label_available_date < cutoff GROUP BY rebalance_date, cutoff, date",
    "bounds": "SELECT rebalance_date, cutoff, min(date) FILTER (back <= 20) AS validation_start, CAST(coalesce(sum(n) FILTER (back > 20), 0) AS BIGINT) AS training_rows, CAST(coalesce(sum(n) FILTER (back <= 20), 0) AS BIGINT) AS validation_rows, count(*) AS dates FROM past GROUP BY rebalance_date, cutoff",
}


def _learning(spark, sf_dir) -> DataFrame:
    return research.learning_frame(all_features(spark, sf_dir), CONFIG, PICK.min_history)


def _bounds(frame: DataFrame) -> DataFrame:
    from quantloom.functions.windows import month_ends

    return research.split_bounds(frame, month_ends(frame), CONFIG)


@query("q5_learning_frame", with_tables("SELECT date, ticker, round(future_return, 6) AS future_return, label_available_date, enough_history, has_model_features, eligible_universe FROM learn", learn=_LEARN["learn"]))
def q5_learning_frame(spark, sf_dir):
    f = _learning(spark, sf_dir)
    return f.select("date", "ticker", r6(F.col("future_return")).alias("future_return"), "label_available_date", "enough_history", "has_model_features", "eligible_universe")


@query("q6_walkforward_splits", with_tables("SELECT rebalance_date, cutoff, validation_start, training_rows, validation_rows, dates > 20 AND training_rows >= 100 AND validation_rows >= 40 AS usable FROM bounds", **_LEARN))
def q6_walkforward_splits(spark, sf_dir):
    return _bounds(_learning(spark, sf_dir))


@query("q8_ridge_walkforward")
def q8_ridge_walkforward(spark, sf_dir):
    """Ridge predictions on each usable month end; the solve is numeric, so rows only."""
    frame = _learning(spark, sf_dir)
    bounds = _bounds(frame).where("usable")
    usable = frame.where("eligible_universe and enough_history and has_model_features and has_training_label")
    fitted = models.ridge_models(usable, bounds.select("rebalance_date", "cutoff"), CONFIG.columns, 8.0, CONFIG.min_training)
    live = frame.where("eligible_universe and enough_history and has_model_features")
    predicted = models.predict_linear(live, fitted, CONFIG.columns).select("date", "ticker", "trend_ok", "predicted_return", "train_rows")
    return strategy.weigh_predictions(predicted, PICK).drop("trend_ok")


@query("t3_ridge_selection")
def t3_ridge_selection(spark, sf_dir):
    return q8_ridge_walkforward(spark, sf_dir).where("weight > 0").select("date", "ticker", "predicted_return", "rank", "weight")


_SEQUENCE = ("ret_5", "ret_20", "rel_ret_20", "vol_20", "drawdown_20", "range_pct_20")


def _network(name: str, kind: str):
    @query(name)
    def own(spark, sf_dir):
        frame = models.sequences(_learning(spark, sf_dir), _SEQUENCE, 10)
        from quantloom.functions.windows import month_ends

        # Each usable month end is a model of its own.
        bounds = research.split_bounds(frame, month_ends(frame), CONFIG).where("usable")
        usable = frame.where("eligible_universe and enough_history and has_training_label")
        predicted = models.network_predictions(usable, bounds, kind, frame.where("eligible_universe and enough_history"), clip=0.95)
        return strategy.weigh_predictions(predicted, PICK)


for _q, _k in (("q10_mlp", "mlp"), ("q11_tcn", "tcn"), ("q12_hybrid", "hybrid"), ("q13_lstm", "lstm"), ("q14_transformer", "transformer")):
    _network(_q, _k)


@query("w23_sequences", with_tables("SELECT date, ticker, CAST(10 AS INT) AS steps, round(ret_20, 5) AS last_ret_20 FROM (SELECT *, min(CAST(ok AS INT)) OVER w AS all_ok, count(*) OVER w AS n FROM (SELECT date, ticker, ret_20, ret_5 IS NOT NULL AND ret_20 IS NOT NULL AND vol_20 IS NOT NULL AS ok FROM price_feats) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE all_ok = 1 AND n = 10"))
def w23_sequences(spark, sf_dir):
    from quantloom.operators import features

    frame = features.price_features(panel.prices(spark, sf_dir))
    s = models.sequences(frame, ("ret_5", "ret_20", "vol_20"), 10)
    return s.select("date", "ticker", F.size("sequence").alias("steps"), rounded_to(F.col("ret_20"), 5).alias("last_ret_20"))


# --- reports ---------------------------------------------------------------


def _windows(spark, sf_dir) -> DataFrame:
    """Ending capital by model and window: each part of the week's sales is a model, each year a window."""
    days = panel.table(spark, sf_dir, "orders")
    return days.groupBy(F.concat(F.lit("model_"), F.substring("o_orderpriority", 1, 1)).alias("model_name"), F.year("o_orderdate").cast("string").alias("window_label")).agg(
        F.max(F.to_date("o_orderdate")).alias("eval_end"), (F.sum(F.floor(100 * F.col("o_totalprice") + 0.5).cast("long")).cast("double") / F.lit(100.0)).alias("ending_capital")
    )


_REPORT = {
    "wins": "SELECT 'model_' || substr(o_orderpriority, 1, 1) AS model_name, CAST(year(o_orderdate) AS VARCHAR) AS window_label, max(o_orderdate::DATE) AS eval_end, CAST(sum(CAST(floor(100 * o_totalprice + 0.5) AS BIGINT)) AS DOUBLE) / 100e0 AS ending_capital FROM orders GROUP BY 1, 2",
    "gaps": "SELECT *, ending_capital - max(CASE WHEN model_name = 'model_1' THEN ending_capital END) OVER (PARTITION BY window_label) AS gap FROM wins",
    "agg": "SELECT model_name, count(DISTINCT window_label) AS window_count, avg(ending_capital) AS avg_ending_capital, median(ending_capital) AS median_ending_capital, avg(gap) AS avg_gap, median(gap) AS median_gap, min(gap) AS worst_gap, max(gap) AS best_gap, stddev_pop(gap) AS gap_std, avg(CAST(gap > 0 AS DOUBLE)) AS beat_rate, count(*) FILTER (gap > 0) AS windows_beaten FROM gaps GROUP BY model_name",
}


@query("j15_baseline_gap", with_tables("SELECT model_name, window_label, round(ending_capital, 3) AS ending_capital, round(gap, 3) AS gap, gap > 0 AS beat_baseline FROM gaps", **_REPORT))
def j15_baseline_gap(spark, sf_dir):
    rows, _ = research.stability(_windows(spark, sf_dir), "model_1")
    return rows.select("model_name", "window_label", rounded_to(F.col("ending_capital"), 3).alias("ending_capital"), rounded_to(F.col("ending_capital_gap_vs_baseline"), 3).alias("gap"), "beat_baseline")


_AGG = "avg_ending_capital median_ending_capital avg_gap median_gap worst_gap best_gap gap_std".split()


@query("a7_stability_aggregate", with_tables(f"SELECT model_name, window_count, {', '.join(f'round({c}, 3) AS {c}' for c in _AGG)}, round(beat_rate, 6) AS beat_rate, windows_beaten FROM agg", **_REPORT))
def a7_stability_aggregate(spark, sf_dir):
    _, agg = research.stability(_windows(spark, sf_dir), "model_1")
    return agg.select("model_name", "window_count", *[rounded_to(F.col(c), 3).alias(c) for c in _AGG], r6(F.col("beat_rate")).alias("beat_rate"), "windows_beaten")


@query("q35_leaderboard", with_tables("""SELECT model_name, round(avg_gap, 3) AS avg_gap, round(latest_gap, 3) AS latest_gap, CASE WHEN avg_gap > 0 AND beat_rate >= 0.5 THEN 'promote' WHEN latest_gap > 0 THEN 'challenger' ELSE 'deprioritize' END AS priority_tier,
    beat_rate >= 0.5 AND worst_gap > -5000 AS robust_positive_windows, row_number() OVER (ORDER BY avg_gap DESC, worst_gap DESC, beat_rate DESC, latest_gap DESC NULLS LAST, model_name) AS rank
    FROM agg LEFT JOIN (SELECT model_name, gap AS latest_gap FROM gaps WHERE eval_end = (SELECT max(eval_end) FROM gaps)) USING (model_name)""", **_REPORT))
def q35_leaderboard(spark, sf_dir):
    rows, agg = research.stability(_windows(spark, sf_dir), "model_1")
    last = rows.agg(F.max("eval_end").alias("eval_end"))
    year = rows.join(last, "eval_end").select("model_name", F.col("ending_capital_gap_vs_baseline").alias("latest_report_gap"))
    board = research.leaderboard(rows, agg, year)
    return board.select("model_name", rounded_to(F.col("avg_gap"), 3).alias("avg_gap"), rounded_to(F.col("latest_gap"), 3).alias("latest_gap"), "priority_tier", "robust_positive_windows", "rank")


@query("a23_changed_rebalances", with_tables("SELECT count(*) FILTER (changed) AS changed_rebalance_count, count(*) AS compared_dates FROM (SELECT w.date, bool_or(abs(w.weight - b.weight) > 1e-8 + 1e-5 * abs(b.weight)) AS changed FROM weights w JOIN (SELECT *, CASE WHEN year(date) >= 2000 THEN weight * 0.5e0 ELSE weight END AS w2 FROM weights) v ON v.date = w.date AND v.ticker = w.ticker, LATERAL (SELECT v.w2 AS weight) b GROUP BY w.date)"))
def a23_changed_rebalances(spark, sf_dir):
    base = weights(spark, sf_dir)
    return research.changed_rebalances(base, base.withColumn("weight", F.when(F.year("date") >= 2000, F.col("weight") * 0.5).otherwise(F.col("weight"))))


@query("a10_signal_coverage", with_tables("SELECT round(avg(CAST(abs(llm_score) > 0 AS DOUBLE)), 6) AS coverage, round(avg(abs(llm_score)), 6) AS mean_abs_score FROM scored"))
def a10_signal_coverage(spark, sf_dir):
    from quantloom.operators import signals

    return rounded(research.signal_coverage(signals.attach_scores(all_features(spark, sf_dir), short_scores(spark, sf_dir))))


@query("a4_window_summaries", with_tables("SELECT CAST(year(date) AS INT) AS year, count(*) AS n_days, round(sum(turnover), 6) AS turnover, round(sum(linear_cost + spread_cost + impact_cost), 6) AS total_cost FROM bt GROUP BY 1"))
def a4_window_summaries(spark, sf_dir):
    days = backtest_days(spark, sf_dir)
    total = F.sum(F.col("linear_cost") + F.col("spread_cost") + F.col("impact_cost"))
    return rounded(days.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_days"), F.sum("turnover").alias("turnover"), total.alias("total_cost")))


@query("a20_clip_quantiles", with_tables("SELECT round(quantile_cont(ret_20, 0.025e0), 6) AS low, round(quantile_cont(ret_20, 0.975e0), 6) AS high, round(min(ret_20), 6) AS least, round(max(ret_20), 6) AS most FROM prices_returns WHERE ret_20 IS NOT NULL"))
def a20_clip_quantiles(spark, sf_dir):
    from quantloom.functions.windows import change

    r = panel.prices(spark, sf_dir).select(change(F.col("close"), 20).alias("ret_20"))
    return rounded(r.agg(F.percentile("ret_20", 0.025).alias("low"), F.percentile("ret_20", 0.975).alias("high"), F.min("ret_20").alias("least"), F.max("ret_20").alias("most")))


@query("j17_curves_by_model", with_tables("SELECT date, round(ln(max(CASE WHEN model = 'net' THEN v END)), 6) AS net, round(ln(max(CASE WHEN model = 'gross' THEN v END)), 6) AS gross FROM (SELECT date, 'net' AS model, equity AS v FROM curves UNION ALL SELECT date, 'gross', gross_equity FROM curves) GROUP BY date"))
def j17_curves_by_model(spark, sf_dir):
    c = metrics.with_curves(backtest_days(spark, sf_dir))
    long = c.select("date", F.inline(F.array(F.struct(F.lit("net").alias("model"), F.ln("equity").alias("v")), F.struct(F.lit("gross").alias("model"), F.ln("gross_equity").alias("v")))))
    return rounded(long.groupBy("date").pivot("model", ["net", "gross"]).agg(F.max("v")))


QUERIES = {k: v for k, v in _PARENT.items() if k not in _BEFORE}
ORACLE_SQL = {k: v for k, v in _PARENT_SQL.items() if k not in _BEFORE}
