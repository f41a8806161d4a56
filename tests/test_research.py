"""Small cases with known results."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from quantloom.functions.windows import minus_business_days, rank_percentile, zscore
from quantloom.operators import backtest, broker, features, korea, metrics, models, portfolio, research, signals, strategy, text, universe
from quantloom.sources import files


def day(i, start="2025-01-01"):
    return dt.date.fromisoformat(start) + dt.timedelta(days=i)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


PRICES = "date date, ticker string, close double, volume double"


def business_days(start, n):
    out, d = [], dt.date.fromisoformat(start)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def test_lagged_weights_earn(spark):
    prices = frame(spark, [(day(i), "AAA", c, 1.0) for i, c in enumerate((100.0, 110.0, 121.0, 133.1))], PRICES)
    w = prices.select("date", "ticker", F.lit(1.0).alias("weight"))
    days = backtest.run(prices, w, backtest.Costs(transaction_bps=0)).orderBy("date").collect()
    assert [round(r.net_return, 9) for r in days] == [0, 0.1, 0.1, 0.1]


def test_limits_scale_the_weights(spark):
    prices = frame(spark, [(day(i), "AAA", c, 1.0) for i, c in enumerate((100.0, 110.0))], PRICES)
    w = prices.select("date", "ticker", F.lit(1.0).alias("weight"))
    days = backtest.run(prices, w, backtest.Costs(transaction_bps=0), cap=1.0, cash_buffer=0.10).orderBy("date").collect()
    assert round(days[0].turnover, 9) == 0.9 and round(days[1].net_return, 9) == 0.09
    three = frame(spark, [(day(0), t, 0.5) for t in "abc"], "date date, ticker string, weight double")
    got = [r.weight for r in strategy.limit_weights(three, 0.40, 0.10).collect()]
    assert round(sum(got), 9) == 0.9 and max(got) <= 0.3 + 1e-9


def test_spread_and_impact(spark):
    prices = frame(spark, [(day(i), "AAA", c, 1000.0) for i, c in enumerate((100.0, 110.0, 110.0))], PRICES)
    w = frame(spark, [(day(i), "AAA", x) for i, x in enumerate((1.0, 1.0, 0.0))], "date date, ticker string, weight double")
    costs = backtest.Costs(transaction_bps=10, spread_bps=5, impact_bps=20, impact_exponent=1.0, liquidity_lookback=1)
    d = backtest.run(prices, w, costs).orderBy("date").collect()
    assert round(d[1].gross_return, 9) == 0.1
    assert [round(x, 9) for x in (d[0].linear_cost, d[0].spread_cost, d[0].impact_cost, d[0].max_participation)] == [0.001, 0.0005, 0.002, 1.0]
    assert metrics.summary(backtest.run(prices, w, costs)).first().cost_drag_total_return > 0


def test_metrics_of_an_empty_backtest_are_zero(spark):
    empty = frame(spark, [], "date date, gross_return double, net_return double, turnover double, linear_cost double, spread_cost double, impact_cost double, max_participation double")
    assert set(metrics.summary(empty).first()) == {0.0}


def test_zscore_and_rank_rules(spark):
    from pyspark.sql import Window

    f = frame(spark, [(1, 1.0), (1, 1.0), (1, None), (2, 5.0), (2, None), (3, 1.0), (3, 2.0), (3, 2.0)], "g int, x double")
    got = f.select("g", "x", zscore(F.col("x"), Window.partitionBy("g")).alias("z"), rank_percentile(F.col("x"), ["g"]).alias("p")).collect()
    assert all(r.z == 0 for r in got if r.g in (1, 2))
    assert sorted((r.g, r.x or -1, r.p) for r in got if r.g != 1) == [(2, -1, 0.5), (2, 5.0, 0.5), (3, 1.0, 1 / 3), (3, 2.0, 2.5 / 3), (3, 2.0, 2.5 / 3)]


def test_business_days_match_numpy(spark):
    days = [day(i) for i in range(30)]
    for n in (0, 1, 5, 7, 13):
        got = frame(spark, [(d,) for d in days], "d date").select("d", minus_business_days(F.col("d"), n).alias("b")).collect()
        for r in got:
            assert r.b == np.busday_offset(r.d, -n, roll="forward").astype(object)


def test_universe_switches_on_the_snapshot_date(spark):
    rows = [(d, t, 100.0, 1.0) for d in business_days("2024-08-26", 10) for t in ("AAA", "BBB", "CCC")]
    snaps = frame(spark, [(dt.date(2024, 8, 28), "AAA"), (dt.date(2024, 8, 28), "BBB"), (dt.date(2024, 9, 2), "AAA"), (dt.date(2024, 9, 2), "CCC")], "effective_date date, ticker string")
    kept = {(r.date, r.ticker) for r in universe.apply_snapshots(frame(spark, rows, PRICES), snaps).collect()}
    assert min(d for d, _ in kept) == dt.date(2024, 8, 28)
    assert (dt.date(2024, 8, 30), "CCC") not in kept and (dt.date(2024, 9, 2), "CCC") in kept and (dt.date(2024, 9, 2), "BBB") not in kept


def test_snapshots_do_not_look_ahead(spark):
    d = business_days("2024-01-01", 140)
    prices = frame(spark, [(x, "AAA", 100.0, 1e6 if i < 90 else 1e7) for i, x in enumerate(d)], PRICES)
    got = {r.effective_date: r.avg_dollar_volume_60 for r in universe.build_snapshots(prices, 1, 5.0, 5e7, 0).collect()}
    assert round(got[dt.date(2024, 3, 29)]) == 100_000_000


def test_asof_takes_the_last_row_whole(spark):
    left = frame(spark, [(day(29), "A"), (day(30), "A"), (day(58), "A"), (day(0), "A"), (day(9), "B")], "date date, ticker string")
    right = frame(spark, [(day(14), "A", 0.2, None), (day(40), "A", -0.4, "x"), (day(14), "A", 0.1, "y")], "date date, ticker string, llm_score double, note string")
    got = {(r.date, r.ticker): (r.llm_score, r.note) for r in signals.attach_scores(left, right, ("llm_score", "note")).collect()}
    assert got == {(day(29), "A"): (0.2, ""), (day(30), "A"): (0.2, ""), (day(58), "A"): (-0.4, "x"), (day(0), "A"): (0.0, ""), (day(9), "B"): (0.0, "")}


def test_section_weighted_mean(spark):
    rows = [(day(0), "A", "swing", 0.5, 0.9, 0.0, "forward_guidance", "d", "s1"), (day(0), "A", "swing", -0.2, 0.1, 0.0, "risk_factors", "d", "s2")]
    scored = frame(spark, rows, "date date, ticker string, horizon_bucket string, adjusted_score double, confidence double, risk_flag double, section_type string, document_id string, section_id string")
    r = signals.aggregate_scores(scored).first()
    assert round(r.llm_score, 2) == 0.47 or round(r.llm_score, 3) == 0.475
    assert (r.document_count, r.section_count) == (1, 2)


def test_portfolio_orders_and_fills(spark):
    w = frame(spark, [(dt.date(2025, 1, 31), "AAA", 0.6), (dt.date(2025, 1, 31), "BBB", 0.4), (dt.date(2025, 2, 28), "AAA", 0.0), (dt.date(2025, 2, 28), "BBB", 1.0)], "date date, ticker string, weight double")
    prices = frame(spark, [(dt.date(2025, 2, 28), "AAA", 25.0, 1.0), (dt.date(2025, 2, 28), "BBB", 50.0, 1.0)], PRICES)
    risk = portfolio.Risk(capital_base=10_000.0, cash_buffer=0.05, max_position_weight=0.40, min_trade_notional=100.0)
    p = portfolio.target_portfolio(w, prices, risk, "2025-03-01")
    assert [(r.ticker, r.date, r.target_shares, round(r.target_weight, 6)) for r in p.collect()] == [("BBB", dt.date(2025, 2, 28), 80.0, 0.4)]
    held = frame(spark, [("AAA", 10.0), ("BBB", 20.0)], "ticker string, shares double")
    orders = portfolio.rebalance_orders(p, held, risk, portfolio.latest_prices(prices))
    assert {(r.ticker, r.side, r.date) for r in orders.collect()} == {("AAA", "SELL", dt.date(2025, 2, 28)), ("BBB", "BUY", dt.date(2025, 2, 28))}


ORDERS = "date date, ticker string, side string, order_shares double, close double"


def test_sells_fill_before_buys(spark):
    orders = frame(spark, [(day(0), "BBB", "BUY", 3.0, 100.0), (day(0), "AAA", "SELL", -2.0, 50.0)], ORDERS)
    held = frame(spark, [("AAA", 2.0)], "ticker string, shares double")
    fills = broker.fill_orders(orders, held, 200.0)
    got = fills.orderBy("rank").collect()
    assert [(r.ticker, r.filled_shares, r.cash_after, r.status) for r in got] == [("AAA", 2.0, 300.0, "FILLED"), ("BBB", 3.0, 0.0, "FILLED")]
    assert [tuple(r) for r in portfolio.positions_after(held, fills).collect()] == [("BBB", 3.0)]
    one = broker.fill_orders(orders.where("side = 'BUY'"), held, 250.0).first()
    assert (one.filled_shares, one.remaining_shares, one.cash_after, one.status) == (2.0, 1.0, 50.0, "PARTIALLY_FILLED")
    none = broker.fill_orders(frame(spark, [(day(0), "X", "SELL", -1.0, 5.0), (day(0), "Y", "BUY", 1.0, 0.0)], ORDERS), held, 0.0)
    assert {r.reject_reason for r in none.collect()} == {"insufficient_shares", "missing_price"}


def test_signal_events_trade_on_the_next_day(spark):
    prices = frame(spark, [(dt.date(2025, 1, d), "A", c, 1.0) for d, c in ((3, 100.0), (6, 101.0), (7, 104.0), (8, 106.0))], PRICES)
    scores = frame(spark, [(dt.date(2025, 1, 3), "A", 0.6), (dt.date(2025, 1, 1), "A", 0.1), (dt.date(2025, 1, 8), "A", 0.2)], "date date, ticker string, llm_score double")
    got = {r.signal_date: r for r in research.signal_events(scores, prices, (1, 2)).collect()}
    r = got[dt.date(2025, 1, 3)]
    assert (r.trade_date, r.trade_close) == (dt.date(2025, 1, 6), 101.0)
    assert round(r.forward_1d_return, 9) == round(104 / 101 - 1, 9) and round(r.forward_2d_return, 9) == round(106 / 101 - 1, 9)
    assert got[dt.date(2025, 1, 1)].trade_date == dt.date(2025, 1, 3) and got[dt.date(2025, 1, 8)].trade_date is None


def test_signal_strategy_holds_until_the_next_event(spark):
    days = [dt.date(2025, 1, d) for d in (3, 6, 7, 8, 9)]
    prices = frame(spark, [(d, "A", c, 1.0) for d, c in zip(days, (100.0, 110.0, 99.0, 108.9, 119.79), strict=True)], PRICES)
    events = frame(spark, [("A", days[0], days[1], 0.5), ("A", days[2], days[3], -0.2)], "ticker string, signal_date date, trade_date date, llm_score double")
    got = research.signal_strategy(prices, events).orderBy("date").collect()
    assert [r.live_position for r in got] == [0, 0, 0.5, 0.5, 0]
    assert round(got[2].strategy_return, 9) == -0.05 and round(got[4].portfolio_value, 6) == 99_750.0


def test_embargo_is_strict(spark):
    d = business_days("2023-12-01", 280)
    prices = frame(spark, [(x, "A", 100 * 1.002**i, 1.0) for i, x in enumerate(d)], PRICES)
    f = prices.withColumns({"trend_ok": F.lit(True), "market_trend_ok": F.lit(True), "ret_5": F.lit(0.1)})
    config = research.WalkForward(horizon=5, validation_dates=10, embargo=5, min_training=20, min_validation=5, columns=("ret_5",))
    learn = research.learning_frame(f, config, 1)
    at = frame(spark, [(dt.date(2024, 12, 13),)], "date date")
    b = research.split_bounds(learn, at, config).first()
    assert b.cutoff == dt.date(2024, 12, 6) and b.usable and b.validation_rows == 10
    assert learn.where(F.col("label_available_date") < F.lit(b.cutoff)).agg(F.max("label_available_date")).first()[0] < dt.date(2024, 12, 6)


def test_ridge_equals_the_direct_solution(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = x @ [0.5, -0.2] + 0.1 + rng.normal(size=80) * 0.01
    rows = frame(spark, [(day(i), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "label_available_date date, a double, b double, future_return double")
    at = frame(spark, [(day(60), day(50))], "rebalance_date date, cutoff date")
    m = models.ridge_models(rows, at, ("a", "b"), 8.0, 10).first()
    s = (x[:50] - x[:50].mean(0)) / x[:50].std(0)
    one = np.column_stack([np.ones(50), s])
    want = np.linalg.solve(one.T @ one + np.diag([0, 8.0, 8.0]), one.T @ y[:50])
    assert m.train_rows == 50 and np.allclose([m.intercept, *m.beta], want)


@pytest.mark.parametrize("kind", list(models.NETWORKS))
def test_networks_learn_and_their_gradients_are_right(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6, 3))
    y = 0.8 * np.tanh(x[:, -1, 0]) - 0.5 * x[:, :, 1].mean(1)
    net = models.NETWORKS[kind](x.shape[1:], rng)
    out, kept = net.forward(x[:5])
    grads = net.backward(np.ones(5), kept)
    for p, g in zip(net.params, grads, strict=True):
        i = tuple(0 for _ in p.shape)
        p[i] += 1e-6
        up = net.forward(x[:5])[0].sum()
        p[i] -= 1e-6
        assert abs((up - out.sum()) / 1e-6 - g[i]) < 1e-3
    _, mse = models.fit_network(kind, x[:450], y[:450], x[450:], y[450:], epochs=40)
    assert mse < 0.9 * y[450:].var()


def test_sequences_need_whole_windows(spark):
    f = frame(spark, [(day(i), "A", float(i) if i != 3 else None) for i in range(8)], "date date, ticker string, x double")
    got = {r.date: [v[0] for v in r.sequence] for r in models.sequences(f, ("x",), 3).collect()}
    assert got == {day(2): [0, 1, 2], day(6): [4, 5, 6], day(7): [5, 6, 7]}


def test_korean_features_and_sessions(spark):
    bars = [(dt.date(2026, 3, d), "005930.KS", c, c, c, 10.0) for d, c in ((17, 70000.0), (18, 71400.0), (19, 72114.0))]
    prices = frame(spark, bars, "date date, ticker string, close double, high double, low double, volume double")
    bench = frame(spark, [(dt.date(2026, 3, d), c) for d, c in ((17, 30000.0), (18, 30300.0), (19, 30603.0))], "date date, close double")
    filings = frame(spark, [(dt.date(2026, 3, 18), "005930.KS", "earnings"), (dt.date(2026, 3, 18), "005930.KS", "governance"), (dt.date(2026, 3, 19), "005930.KS", "capital_event")], "session_date date, ticker string, category string")
    got = korea.build_features(prices, filings, bench).orderBy("date").collect()
    assert (got[1].filing_count, got[1].earnings_filing_count) == (2, 1) and (got[2].capital_event_count, got[2].days_since_last_filing) == (1, 0)
    assert round(got[2].benchmark_ret_1, 9) == 0.01 and got[2].market_trend_ok == 1.0
    plain = korea.build_features(prices).first()
    assert (plain.filing_count, plain.days_since_last_filing, plain.benchmark_ret_20, plain.market_trend_ok) == (0, 9999, 0, 1)


def test_filings_after_the_close_move_on(spark):
    at = frame(spark, [(1, "2026-03-20 16:05:00"), (2, "2026-03-20 14:00:00"), (3, "2026-03-21 09:00:00")], "k int, t string").withColumn("filed_at", korea.filed_at(F.col("t")))
    calendar = frame(spark, [(dt.date(2026, 3, d),) for d in (19, 20, 23)], "date date")
    got = {r.k: r.session_date for r in korea.session_dates(at, calendar).collect()}
    assert got == {1: dt.date(2026, 3, 23), 2: dt.date(2026, 3, 20), 3: dt.date(2026, 3, 23)}


def test_korean_texts(spark):
    f = frame(spark, [("5930.ks", "분기보고서"), ("abc", "BW 발행"), ("0000001", None)], "t string, title string")
    got = f.select(korea.listing_code(F.col("t")).alias("c"), korea.vendor_suffix(F.col("t")).alias("s"), korea.filing_class(F.lit(None).cast("string"), F.col("title")).alias("k")).collect()
    assert [tuple(r) for r in got] == [("005930", "KS", "quarterly_report"), (None, None, "capital_event"), (None, None, "other")]
    chart = {"chart": {"result": [{"timestamp": [1767225600, 1767312000], "indicators": {"quote": [{"open": [1, None], "high": [2, 2], "low": [1, 1], "close": [2, 2], "volume": [5, 5]}]}, "meta": {"exchangeTimezoneName": "Asia/Seoul", "currency": "KRW"}}]}}
    bars = korea.chart_bars(frame(spark, [("x", json.dumps(chart))], "ticker string, payload string")).collect()
    assert [(r.date, r.close, r.adj_close) for r in bars] == [(dt.date(2026, 1, 1), 2.0, 2.0)]


def test_text_pieces(spark):
    page = "<html><head><title>t</title></head><body><p>A&amp;B</p><div style='display: none'>x</div><script>y</script><ix:h>z</ix:h><p>c<br>d</p></body></html>"
    assert text.html_text(page) == "A&B c d" and text.html_text(None) == ""
    body = "Item 2.02 Results were strong and we expect growth. Item 7.01 Regulation. SIGNATURES"
    r = frame(spark, [(body,)], "t string").select(text.items(F.col("t")).alias("i"), text.sentences(F.lit("A b. C d! e")).alias("x")).first()
    assert list(r.i) == ["2.02", "7.01"]
    assert list(r.x) == ["A b.", "C d!", "e"]
    d = frame(spark, [("strong growth but antitrust risk", "forward_guidance")], "text string, section_type string")
    assert all(x.score > 0 for x in text.horizon_scores(text.keyword_scores(d)).collect())


def test_selection_and_hold(spark):
    rows = [(dt.date(2025, m, d), t, r, r, v, True) for m, d in ((1, 30), (1, 31), (2, 27), (2, 28)) for t, r, v in (("AAA", 0.2, 0.1), ("BBB", 0.1, 0.2))]
    f = frame(spark, rows, "date date, ticker string, ret_20 double, ret_60 double, vol_20 double, trend_ok boolean").withColumn("close", F.lit(1.0))
    rules = strategy.Rules(top_n=1, min_history=1)
    got = {(r.date, r.ticker): r.weight for r in strategy.target_weights(f, rules).collect()}
    assert got[dt.date(2025, 1, 31), "AAA"] == 1.0 and got[dt.date(2025, 2, 27), "AAA"] == 1.0 and got[dt.date(2025, 1, 30), "AAA"] == 0.0
    scores = frame(spark, [(dt.date(2025, 1, 31), "BBB", 5.0), (dt.date(2025, 1, 31), "AAA", 0.0)], "date date, ticker string, llm_score double")
    other = {(r.date, r.ticker): r.weight for r in strategy.target_weights(f, strategy.Rules(top_n=1, min_history=1, llm_weight=2.0), scores).collect()}
    assert other[dt.date(2025, 1, 31), "BBB"] == 1.0
    with pytest.raises(ValueError):
        strategy.Rules(trend_mode="none")


def test_features_fill_in_late(spark):
    d = business_days("2024-01-01", 260)
    prices = frame(spark, [(x, t, 100.0 + i * k, 101.0 + i * k, 99.0 + i * k, 100.0 + i * k, 1000.0) for i, x in enumerate(d) for k, t in ((0.1, "A"), (0.2, "B"))], "date date, ticker string, open double, high double, low double, close double, volume double")
    out = features.build_features(prices, prices.where("ticker = 'A'"), frame(spark, [("a", "T")], "ticker string, sector string"))
    last = {r.ticker: r for r in out.where(F.col("date") == F.lit(d[-1])).collect()}
    assert last["A"].sector == "T" and last["B"].sector == "UNKNOWN" and last["B"].sma_200 is not None and last["B"].trend_ok
    first = out.where("ticker = 'A' and vol_20 is not null").agg(F.min("date")).first()[0]
    assert first == d[20]


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,ticker,open,high,low,close,volume\n2025-01-02,aaa,1,2,1,x,5\n")
    r = files.load_prices(spark, str(tmp_path / "p.csv")).first()
    assert (r.date, r.ticker, r.close, r.volume) == (dt.date(2025, 1, 2), "AAA", None, 5.0)
    with pytest.raises(ValueError):
        files.load_metadata(spark, str(tmp_path / "p.csv"))
    (tmp_path / "t.txt").write_text("bbb, aaa # x\naaa ccc\n")
    assert [x.ticker for x in files.load_tickers(spark, str(tmp_path / "t.txt")).collect()] == ["BBB", "AAA", "CCC"]
    (tmp_path / "c.yaml").write_text("tickers: [x]\ntickers_file: t.txt\n")
    assert files.load_config(tmp_path / "c.yaml").tickers == ("BBB", "AAA", "CCC")
    assert files.load_positions(spark, str(tmp_path / "none.csv")).count() == 0
    made = []
    for _ in range(2):
        got = files.cached_table(spark, str(tmp_path / "cache"), {"a": 1}, lambda: made.append(1) or spark.range(3))
    assert len(made) == 1 and got.reused and got.frame.count() == 3
    assert files.frame_digest(spark.range(5)) == files.frame_digest(spark.range(5).repartition(3))
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert files.with_retry(flaky, sleep=lambda s: None) == "ok"
    pages = {1: {"status": "000", "total_page": 2, "list": [1]}, 2: {"status": "000", "total_page": 2, "list": [2]}}
    assert files.list_filings(lambda p: pages[p["page_no"]], corp_code="x") == [1, 2]
    assert "<polyline" in files.svg_chart({"a": [1.0, 2.0]})
    assert files.same_inputs({"a": {"path": "x", "exists": True, "sha256": "1"}}, {"a": {"path": "y", "exists": True, "sha256": "1"}})


def test_reports(spark):
    rows = [("rules", "w1", day(0), 100.0), ("m", "w1", day(0), 120.0), ("rules", "w2", day(9), 100.0), ("m", "w2", day(9), 90.0)]
    w, agg = research.stability(frame(spark, rows, "model_name string, window_label string, eval_end date, ending_capital double"), "rules")
    board = {r.model_name: r for r in research.leaderboard(w, agg, frame(spark, [("m", -1.0)], "model_name string, latest_report_gap double")).collect()}
    assert board["m"].rank == 1 and board["m"].priority_tier == "promote" and board["m"].avg_gap == 5.0
    base = frame(spark, [(day(0), "A", 1.0), (day(30), "A", 1.0)], "date date, ticker string, weight double")
    cand = frame(spark, [(day(0), "A", 1.0), (day(30), "B", 1.0)], "date date, ticker string, weight double")
    assert research.changed_rebalances(base, cand).first().changed_rebalance_count == 1


def test_stream_of_bars_equals_the_batch(spark, tmp_path):
    from quantloom.streaming.bars import daily_bars

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = daily_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, daily_bars(events).collect()))
