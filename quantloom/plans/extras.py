"""Queries of the small operators that the larger ones are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.windows import by_ticker, forward_fill, r6, rolling, rounded_to
from quantloom.operators import backtest, korea, models, portfolio, research, signals, strategy, text
from quantloom.plans.research import COSTS, all_features, backtest_days, query, rounded, weights
from quantloom.plans.research import ORACLE_SQL as _PARENT_SQL
from quantloom.plans.research import QUERIES as _PARENT
from quantloom.plans.sql import with_tables
from quantloom.plans.textlane import _KR, _kr_bars, _kr_features, _kr_filings, _kz
from quantloom.shared import stage_table
from quantloom.sources import panel

_BEFORE = set(_PARENT)


@query("w12_running_count", with_tables("SELECT date, ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) >= 200 AS enough_history FROM prices"))
def w12_running_count(spark, sf_dir):
    return strategy.with_history(panel.prices(spark, sf_dir), 200).select("date", "ticker", "enough_history")


@query("w13_forward_labels", with_tables("SELECT date, ticker, round(lead(close, 20) OVER w / close - 1, 6) AS future_return, lead(date, 20) OVER w AS label_available_date FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)"))
def w13_forward_labels(spark, sf_dir):
    labelled = research.forward_labels(panel.prices(spark, sf_dir), 20)
    return labelled.select("date", "ticker", r6(F.col("future_return")).alias("future_return"), "label_available_date")


@query("j18_dense_panel", with_tables("SELECT d.date, t.ticker, round(last_value(p.close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING), 5) AS close, coalesce(p.volume, 0) AS volume FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT ticker FROM prices) t LEFT JOIN prices p ON p.date = d.date AND p.ticker = t.ticker"))
def j18_dense_panel(spark, sf_dir):
    p = panel.prices(spark, sf_dir)
    grid = strategy.spine(p).join(p, ["date", "ticker"], "left")
    return grid.select("date", "ticker", rounded_to(forward_fill(F.col("close")), 5).alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


@query("w14_forward_fill", with_tables("SELECT date, ticker, round(last_value(CASE WHEN volume > 100 THEN close END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 5) AS last_busy_close FROM prices"))
def w14_forward_fill(spark, sf_dir):
    return panel.prices(spark, sf_dir).select("date", "ticker", rounded_to(forward_fill(F.when(F.col("volume") > 100, F.col("close"))), 5).alias("last_busy_close"))


@query("w15_days_since_filing", with_tables("SELECT date, ticker, days_since_last_filing, filing_count_20 FROM kr_f", **_KR))
def w15_days_since_filing(spark, sf_dir):
    return _kr_features(spark, sf_dir).select("date", "ticker", "days_since_last_filing", "filing_count_20")


@query("p7_kr_relative_returns", with_tables("SELECT date, ticker, round(rel_ret_20, 6) AS rel_ret_20 FROM kr_j", **_KR))
def p7_kr_relative_returns(spark, sf_dir):
    return rounded(_kr_features(spark, sf_dir).select("date", "ticker", "rel_ret_20"))


@query("a2_daily_portfolio", with_tables("SELECT date, round(sum(live * ret), 6) AS gross_return, round(sum(change), 6) AS turnover FROM moves GROUP BY date"))
def a2_daily_portfolio(spark, sf_dir):
    moves = backtest.trades(panel.prices(spark, sf_dir), weights(spark, sf_dir), COSTS, 0.02, 0.04)
    return rounded(backtest.daily(moves, COSTS).select("date", "gross_return", "turnover"))


@query("w20_running_drawdown", with_tables("SELECT date, ticker, round(close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM prices"))
def w20_running_drawdown(spark, sf_dir):
    from quantloom.operators.metrics import running_drawdown

    return panel.prices(spark, sf_dir).select("date", "ticker", r6(running_drawdown(F.col("close"), by_ticker())).alias("drawdown"))


@query("w18_lagged_liquidity", with_tables("SELECT date, ticker, round(CASE WHEN u > 0 THEN u ELSE d END, 5) AS liquidity FROM (SELECT date, ticker, close * volume AS d, avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS u FROM prices)"))
def w18_lagged_liquidity(spark, sf_dir):
    return panel.prices(spark, sf_dir).select("date", "ticker", rounded_to(backtest.usual_liquidity(F.col("close") * F.col("volume"), 8), 5).alias("liquidity"))


@query("p12_target_shares", "SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 0 ELSE floor(1e6 / o_totalprice) END AS shares FROM orders")
def p12_target_shares(spark, sf_dir):
    return panel.table(spark, sf_dir, "orders").select("o_orderkey", portfolio.target_shares(F.lit(1e6), F.col("o_totalprice"), False).alias("shares"))


@query("p13_order_side", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'BUY' WHEN c_acctbal < 0 THEN 'SELL' ELSE 'HOLD' END AS side FROM customer")
def p13_order_side(spark, sf_dir):
    return panel.table(spark, sf_dir, "customer").select("c_custkey", portfolio.side(F.col("c_acctbal")).alias("side"))


@query("p14_clamp", "SELECT c_custkey, greatest(-100, least(5000, c_acctbal)) AS clamped FROM customer")
def p14_clamp(spark, sf_dir):
    return panel.table(spark, sf_dir, "customer").select("c_custkey", text.clamp(F.col("c_acctbal"), -100.0, 5000.0).alias("clamped"))


@query("p17_best_horizon", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= l_tax THEN 'short_term' ELSE 'swing' END AS label FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem)")
def p17_best_horizon(spark, sf_dir):
    rows = panel.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax").distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", research.best_horizon(F.col("l_discount"), F.col("l_tax"), F.lit(-1.0)).alias("label"))


@query("p18_json_features", "SELECT o_orderkey, '{\"price\":' || CAST(o_custkey AS VARCHAR) || ',\"status\":\"' || o_orderstatus || '\",\"tag\":null}' AS price_features FROM orders")
def p18_json_features(spark, sf_dir):
    fields = F.struct(F.col("o_custkey").alias("price"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("tag"))
    return panel.table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(fields, {"ignoreNullFields": "false"}).alias("price_features"))


@query("f6_date_window", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def f6_date_window(spark, sf_dir):
    from quantloom.operators.metrics import between

    return between(panel.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), "1996-01-01", "1996-12-31")


@query("f7_as_of", with_tables("SELECT date, ticker, round(close, 5) AS close FROM prices WHERE date = (SELECT max(date) FROM prices WHERE date <= DATE '1999-05-05')"))
def f7_as_of(spark, sf_dir):
    return portfolio.as_of(panel.prices(spark, sf_dir), "1999-05-05").select("date", "ticker", rounded_to(F.col("close"), 5).alias("close"))


@query("j20_requested_tickers", with_tables("SELECT ticker, ticker IN (SELECT ticker FROM metadata) AS known FROM (VALUES ('S1'), ('S2'), ('S999999')) AS t(ticker)"))
def j20_requested_tickers(spark, sf_dir):
    asked = spark.createDataFrame([("S1",), ("S2",), ("S999999",)], "ticker string")
    known = panel.metadata(spark, sf_dir).select("ticker")
    return asked.join(known, "ticker", "left_semi").withColumn("known", F.lit(True)).unionByName(asked.join(known, "ticker", "left_anti").withColumn("known", F.lit(False)))


@query("a12_hit_rate", "SELECT event_type, round(avg(CASE WHEN user_id % 7 <> 3 THEN CAST(sign(value - 50) = sign(user_id % 7 - 3) AS DOUBLE) END), 6) AS hit_rate FROM events GROUP BY event_type")
def a12_hit_rate(spark, sf_dir):
    e = panel.table(spark, sf_dir, "events")
    return rounded(e.groupBy("event_type").agg(research.hit_rate((F.col("user_id") % 7 - 3).cast("double"), F.col("value") - 50).alias("hit_rate")))


@query("a18_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a18_status_counts(spark, sf_dir):
    return panel.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("a22_ridge_moments", with_tables("SELECT label_available_date, CAST(count(*) AS DOUBLE) AS n, round(sum(ret_5), 5) AS s_0, round(sum(future_return), 5) AS s_1, round(sum(ret_5 * future_return), 5) AS p_0_1 FROM (SELECT ret_5, lead(close, 4) OVER w / nullif(close, 0) - 1 AS future_return, lead(date, 4) OVER w AS label_available_date FROM prices_returns WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE ret_5 IS NOT NULL AND future_return IS NOT NULL GROUP BY 1"))
def a22_ridge_moments(spark, sf_dir):
    from quantloom.operators import features

    w = by_ticker()
    f = features.price_features(panel.prices(spark, sf_dir)).withColumns({"future_return": F.try_divide(F.lead("close", 4).over(w), F.col("close")) - 1, "label_available_date": F.lead("date", 4).over(w)})
    m = models.moments(f.where("ret_5 is not null and future_return is not null"), ["ret_5"])
    return m.select("label_available_date", "n", *[rounded_to(F.col(c), 5).alias(c) for c in ("s_0", "s_1", "p_0_1")])


@query("u1_union_by_name", "SELECT r_regionkey AS key, r_name AS name, -1 AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def u1_union_by_name(spark, sf_dir):
    a = panel.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    b = panel.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region"))
    return a.unionByName(b, allowMissingColumns=True).fillna(-1, ["region"])


@query("d4_lookback_window", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > (SELECT CAST(max(o_orderdate) AS DATE) - 90 FROM orders)")
def d4_lookback_window(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    last = o.agg(F.date_sub(F.to_date(F.max("o_orderdate")), 90).alias("since"))
    return o.join(F.broadcast(last), F.to_date("o_orderdate") > F.col("since")).select("o_orderkey")


@query("m1_standardise", with_tables("SELECT date, ticker, round((ret_20 - avg(ret_20) OVER ()) / CASE WHEN stddev_pop(ret_20) OVER () = 0 THEN 1 ELSE stddev_pop(ret_20) OVER () END, 6) AS scaled FROM prices_returns WHERE ret_20 IS NOT NULL"))
def m1_standardise(spark, sf_dir):
    from quantloom.operators import features

    f = features.price_features(panel.prices(spark, sf_dir)).where("ret_20 is not null").select("date", "ticker", "ret_20")
    stats = f.agg(F.avg("ret_20").alias("m"), F.stddev_pop("ret_20").alias("s"))
    return f.crossJoin(F.broadcast(stats)).select("date", "ticker", r6((F.col("ret_20") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("scaled"))


@query("m5_mse", "SELECT o_orderpriority, round(avg(pow((o_totalprice - 150000) / 1000, 2)), 4) AS mse FROM orders GROUP BY 1")
def m5_mse(spark, sf_dir):
    mse = F.avg(F.pow((F.col("o_totalprice") - 150000) / 1000, F.lit(2)))
    return panel.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(rounded_to(mse, 4).alias("mse"))


@query("x1_clean_names", "SELECT s_suppkey, coalesce(nullif(upper(trim(CASE WHEN s_suppkey % 4 = 0 THEN '  ' ELSE s_name END)), ''), 'UNKNOWN') AS name FROM supplier")
def x1_clean_names(spark, sf_dir):
    from quantloom.sources.files import known_name

    name = F.when(F.col("s_suppkey") % 4 == 0, "  ").otherwise(F.col("s_name"))
    return panel.table(spark, sf_dir, "supplier").select("s_suppkey", F.upper(known_name(name)).alias("name"))


@query("x20_first_given", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS picked FROM orders")
def x20_first_given(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise("")
    return panel.table(spark, sf_dir, "orders").select("o_orderkey", korea.first_given(first, F.lit(None).cast("string"), F.col("o_orderpriority")).alias("picked"))


@query("x21_parse_times", "SELECT event_id, floor(epoch(ts::TIMESTAMP))::BIGINT - CASE WHEN event_id % 3 = 0 THEN floor(epoch(ts::TIMESTAMP))::BIGINT % 86400 WHEN event_id % 3 = 1 THEN floor(epoch(ts::TIMESTAMP))::BIGINT % 60 ELSE 0 END - 32400 AS filed_epoch FROM events")
def x21_parse_times(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    form = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyyMMdd")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyyMMddHHmm")).otherwise(F.date_format(ts, "yyyyMMddHHmmss"))
    return panel.table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(korea.filed_at(form)).alias("filed_epoch"))


@query("x5_truncate", "SELECT doc_id, left(text, 120) AS head, length(text) > 120 AS was_cut FROM documents")
def x5_truncate(spark, sf_dir):
    d = panel.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.left("text", F.lit(120)).alias("head"), (F.char_length("text") > 120).alias("was_cut"))


@query("t5_portfolio_order", with_tables("SELECT effective_date, ticker, row_number() OVER (PARTITION BY effective_date ORDER BY round(avg_dollar_volume_60, 3) DESC, ticker) AS place FROM snapshots"))
def t5_portfolio_order(spark, sf_dir):
    from quantloom.plans.research import snapshots

    w = Window.partitionBy("effective_date").orderBy(rounded_to(F.col("avg_dollar_volume_60"), 3).desc(), "ticker")
    return snapshots(spark, sf_dir).select("effective_date", "ticker", F.row_number().over(w).alias("place"))


@query("q9_gradient_trees")
def q9_gradient_trees(spark, sf_dir):
    """Boosted trees for each usable split of the learning frame, each stopped early on its validation part."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from quantloom.functions.windows import month_ends
    from quantloom.plans.trading import CONFIG, PICK

    frame, _ = stage_table(research.learning_frame(all_features(spark, sf_dir), CONFIG, PICK.min_history), "trees-frame")
    bounds = research.split_bounds(frame, month_ends(frame), CONFIG).where("usable").orderBy("rebalance_date").collect()
    vectors = VectorAssembler(inputCols=list(CONFIG.columns), outputCol="x")
    fit = frame.where("eligible_universe and enough_history and has_model_features")
    rows, _ = stage_table(vectors.transform(fit).select("date", "ticker", "x", "future_return", "label_available_date", "has_training_label"), "trees-rows")
    trees = GBTRegressor(featuresCol="x", labelCol="future_return", validationIndicatorCol="validation", maxIter=10, maxDepth=3, stepSize=0.05, minInstancesPerNode=20, seed=7)

    def one(split) -> str | None:
        live = rows.where(F.col("date") == F.lit(split.rebalance_date))
        if live.isEmpty():
            return None
        train = rows.where(F.col("has_training_label") & (F.col("label_available_date") < F.lit(split.cutoff))).withColumn("validation", F.col("date") >= F.lit(split.validation_start))
        fitted = trees.copy().fit(train.select("x", "future_return", "validation"))
        return stage_table(fitted.transform(live).select("date", "ticker", F.col("prediction").alias("predicted_return")), "trees-predicted")[1]

    # A model is a few small jobs, so several splits run at once.
    with ThreadPoolExecutor(8) as pool:
        paths = [p for p in pool.map(inheritable_thread_target(spark)(one), bounds) if p is not None]
    out = "date date, ticker string, predicted_return double"
    return spark.read.schema(out).parquet(*paths) if paths else spark.createDataFrame([], out)


_KR_RUN = {
    "kr_ends": "SELECT max(date) AS date FROM kr_prices GROUP BY date_trunc('month', date)",
    "kr_scored": f"""SELECT date, ticker, avg_dollar_volume_20, {_kz('ret_20')} * 1e0 + {_kz('ret_5')} * 0.35e0 + {_kz('vol_20')} * -0.25e0 + {_kz('earnings_filing_count_60')} * 0.30e0 + {_kz('capital_event_count_60')} * -0.20e0 AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM kr_f) WHERE k >= 10 AND date IN (SELECT date FROM kr_ends) AND ret_20 IS NOT NULL AND ret_5 IS NOT NULL AND vol_20 IS NOT NULL""",
    "kr_picked": """SELECT date, ticker, 1e0 / count(*) OVER (PARTITION BY date) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, avg_dollar_volume_20 DESC, ticker) AS rank FROM kr_scored) WHERE rank <= 3""",
    "kr_grid": """SELECT d.date, t.ticker, p.close, CASE WHEN d.date IN (SELECT date FROM kr_ends) THEN coalesce(s.weight, 0) END AS given
        FROM (SELECT DISTINCT date FROM kr_prices) d CROSS JOIN (SELECT DISTINCT ticker FROM kr_prices) t
        LEFT JOIN kr_prices p ON p.date = d.date AND p.ticker = t.ticker LEFT JOIN kr_picked s ON s.date = d.date AND s.ticker = t.ticker""",
    "kr_held": """SELECT date, ticker, coalesce(last_value(given IGNORE NULLS) OVER o, 0) AS weight, last_value(close IGNORE NULLS) OVER o AS padded
        FROM kr_grid WINDOW o AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "kr_moves": """SELECT date, weight, lag(weight, 1, 0) OVER o AS live, coalesce(padded / nullif(lag(padded) OVER o, 0) - 1, 0) AS ret
        FROM kr_held WINDOW o AS (PARTITION BY ticker ORDER BY date)""",
    "kr_daily": "SELECT date, sum(live * ret) AS gross_return, sum(abs(weight - live)) AS turnover FROM kr_moves GROUP BY date",
    "kr_bench_ret": "SELECT date, coalesce(close / nullif(lag(close) OVER (ORDER BY date), 0) - 1, 0) AS benchmark_return FROM kr_bench",
}


@query("q38_kr_research_backtest", with_tables("""SELECT date, round(gross_return, 6) AS gross_return, round(gross_return - turnover * 0.0015e0, 6) AS net_return, round(turnover, 6) AS turnover, round(turnover * 0.001e0, 6) AS linear_cost,
    round(turnover * 0.0005e0, 6) AS spread_cost, round(coalesce(benchmark_return, 0), 6) AS benchmark_return FROM kr_daily LEFT JOIN kr_bench_ret USING (date)""", **_KR, **_KR_RUN))
def q38_kr_research_backtest(spark, sf_dir):
    costs = backtest.Costs(transaction_bps=10, spread_bps=5)
    days = korea.research_backtest(_kr_bars(spark, sf_dir, "ticker"), _kr_filings(spark, sf_dir), _kr_bars(spark, sf_dir), korea.Rules(3, 10, True), costs)
    return rounded(days.drop("impact_cost", "max_participation"))


@query("x13_section_weights", "SELECT section, CASE section WHEN 'item_2_02' THEN 1.6 WHEN 'mda' THEN 1.0 WHEN 'risk_factors' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM (VALUES ('item_2_02'), ('mda'), ('risk_factors'), ('none')) AS t(section)")
def x13_section_weights(spark, sf_dir):
    s = spark.createDataFrame([("item_2_02",), ("mda",), ("risk_factors",), ("none",)], "section string")
    return s.select("section", signals.section_weight(F.col("section")).alias("weight"))


QUERIES = {k: v for k, v in _PARENT.items() if k not in _BEFORE}
ORACLE_SQL = {k: v for k, v in _PARENT_SQL.items() if k not in _BEFORE}
