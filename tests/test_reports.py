"""Comparisons, ridge and the broker against plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from quantloom.operators import broker, korea, metrics, models, reports, strategy
from quantloom.sources import files


def days(spark, returns, start=dt.date(2000, 1, 3)):
    rows = [(start + dt.timedelta(days=7 * i), float(r), float(r), 0.0, 0.0, 0.0, 0.0, 0.0) for i, r in enumerate(returns)]
    return spark.createDataFrame(rows, "date date, gross_return double, net_return double, turnover double, linear_cost double, spread_cost double, impact_cost double, max_participation double")


def test_compare_runs_and_last_period(spark):
    rng = np.random.default_rng(1)
    r = {"a": rng.normal(0.001, 0.01, 80), "b": rng.normal(0.002, 0.02, 80)}
    own = {k: days(spark, v) for k, v in r.items()}
    d = [x.date for x in own["a"].orderBy("date").collect()]
    base = [(d[10], "X", 0.5, 0.0), (d[20], "X", 0.5, 0.4), (d[30], "Y", 1.0, -0.2)]
    other = [(d[10], "X", 0.5, 0.0), (d[20], "X", 0.5 + 1e-9, 0.4), (d[30], "Z", 1.0, 0.0), (d[40], "Z", 1.0, 0.0)]
    schema = "date date, ticker string, weight double, llm_score double"
    got = {x.config_name: x for x in reports.compare_runs(own, {"a": spark.createDataFrame(base, schema), "b": spark.createDataFrame(other, schema)}).collect()}
    assert got["a"].changed_rebalance_count == 0 and got["b"].changed_rebalance_count == 1
    assert got["a"].coverage == pytest.approx(2 / 3) and got["b"].coverage == pytest.approx(1 / 4)
    for k, v in r.items():
        assert got[k].total_return == pytest.approx(np.prod(1 + v) - 1)
        assert got[k].sharpe == pytest.approx(v.mean() / v.std() * math.sqrt(252))
    table, curves = reports.last_period(own, 140, 1000.0)
    rows = {x.config_name: x for x in table.collect()}
    for k, v in r.items():
        late = v[-21:]
        end = 1000 * np.prod(1 + late[1:])
        assert rows[k].ending_capital == pytest.approx(end) and rows[k].profit_dollars == pytest.approx(end - 1000)
        assert rows[k].eval_start == d[-21] and rows[k].eval_end == d[-1]
    best = max(rows, key=lambda k: rows[k].ending_capital)
    assert rows[best].place == 1 and curves.columns == ["date", "a", "b"] and curves.count() == 21
    with pytest.raises(ValueError, match="b"):
        reports.require_same_data({"a": {"x": 1}, "b": {"x": 2}})


def test_grids_and_names(spark):
    assert reports.int_grid("1, 2,") == [1, 2] and reports.optional_grid("raw,0.5,None") == [None, 0.5, None]
    for f in (reports.int_grid, reports.optional_grid):
        with pytest.raises(ValueError):
            f(" , ")
    q = spark.createDataFrame([(0.95,), (0.975,), (0.9,), (1.0,), (None,)], "q double").select(reports.objective_name(F.col("q")).alias("n"))
    assert [r.n for r in q.collect()] == ["clip_q95", "clip_q97p5", "clip_q90", "clip_q100", "raw"]


def test_expanding_ridge_is_a_direct_fit(spark):
    rng = np.random.default_rng(2)
    dates = [dt.date(2000, 1, 31) + dt.timedelta(days=30 * i) for i in range(12)]
    rows = []
    for i, d in enumerate(dates):
        for t in range(15):
            x = rng.normal(size=2)
            y = float(0.3 * x[0] - 0.1 * x[1] + rng.normal() * 0.01) if i < 11 else None
            rows.append((d, f"T{t}", float(x[0]), float(x[1]) * 3 + 1, bool(t % 2), y, dates[i + 1] if i < 11 else None))
    f = spark.createDataFrame(rows, "date date, ticker string, a double, b double, trend_ok boolean, future_return double, label_available_date date")
    asked = f.select("date").distinct()
    got = models.expanding_ridge(f, asked, ("a", "b"), alpha=4.0, min_rows=40).collect()
    assert {r.date for r in got} == set(dates[4:])
    for r in got:
        known = [x for x in rows if x[6] is not None and x[6] < r.date]
        x, y = np.array([k[2:4] for k in known]), np.array([k[5] for k in known])
        mean, sd = x.mean(0), x.std(0)
        z = (x - mean) / sd
        beta = np.linalg.solve(z.T @ z + 4.0 * np.eye(2), z.T @ (y - y.mean()))
        assert r.predicted_return == pytest.approx(y.mean() + ((np.array([r.a, r.b]) - mean) / sd) @ beta, rel=1e-6, abs=1e-9) and r.train_rows == len(known)
    predicted = models.expanding_ridge(f, asked, ("a", "b"), 4.0, 40)
    soft = strategy.weigh_predictions(predicted, strategy.Rules(top_n=3, trend_mode="soft", trend_penalty=10.0)).where("weight > 0").collect()
    assert all(r.trend_ok and r.weight == pytest.approx(1 / 3) for r in soft) and len(soft) == 3 * 8
    hard = strategy.weigh_predictions(predicted, strategy.Rules(top_n=30, trend_mode="hard"))
    assert hard.where("not trend_ok").count() == 0 and hard.groupBy("date").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9").count() == 0


def test_sells_share_a_holding_and_prices_fall_back(spark):
    o = spark.createDataFrame([("AAA", "SELL", -3.0, 2.0, 1), ("aaa", "SELL", -3.0, 2.0, 2), ("BBB", "BUY", 10.0, 0.0, 1), ("CCC", "BUY", 1.0, 0.0, 1), ("DDD", "HOLD", 1.0, 1.0, 1)], "ticker string, side string, order_shares double, close double, seq int")
    held = spark.createDataFrame([("AAA", 4.0)], "ticker string, shares double")
    latest = spark.createDataFrame([("BBB", 3.0)], "ticker string, close double")
    got = broker.fill_orders(o, held, 0.0, 0.0, False, latest).orderBy("rank").collect()
    assert [(r.ticker, r.filled_shares, r.status, r.reject_reason) for r in got] == [("AAA", 3.0, "FILLED", None), ("AAA", 1.0, "PARTIALLY_FILLED", None), ("BBB", 2.0, "PARTIALLY_FILLED", None), ("CCC", 0.0, "REJECTED", "missing_price")]
    assert got[-1].cash_after == pytest.approx(2.0)
    s = broker.account_summary(broker.fill_orders(o, held, 0.0, 0.0, False, latest), held, spark.createDataFrame([("AAA", 2.0), ("BBB", 3.0)], "ticker string, close double"), 0.0).first()
    assert (s.order_count_submitted, s.filled_order_count, s.partial_order_count, s.fill_count) == (4, 1, 2, 3) and s.ending_total_equity == pytest.approx(8.0) == pytest.approx(s.starting_total_equity)
    assert broker.fill_orders(o.limit(0), held, 1.0).count() == 0


def test_accounts_are_independent_and_large(spark):
    n = 3000
    o = spark.range(n).selectExpr("id % 3 as account", "concat('T', id) as ticker", "'BUY' as side", "1.0 as order_shares", "1.0 as close")
    held = spark.createDataFrame([], "account long, ticker string, shares double")
    got = {r.account: r.n for r in broker.fill_orders(o, held, 100.0).groupBy("account").agg(F.sum("filled_shares").alias("n")).collect()}
    assert got == {0: 100.0, 1: 100.0, 2: 100.0}


def test_check_readiness():
    class Client:
        def __init__(self, ok):
            self.ok = ok

        def account(self):
            if not self.ok:
                raise OSError("down")
            return {"cash": "3", "status": "ACTIVE"}

        def positions(self):
            return [{}]

    def no_key():
        raise ValueError("no key")

    assert broker.check_readiness(" Local")["ready"]
    assert broker.check_readiness("other")["error"]
    assert not broker.check_readiness("remote", no_key, True)["credentials_present"]
    assert broker.check_readiness("remote", lambda: Client(False))["ready"]
    bad = broker.check_readiness("remote", lambda: Client(False), True)
    assert not bad["ready"] and bad["connectivity_ok"] is False
    good = broker.check_readiness("remote", lambda: Client(True), True)
    assert good["ready"] and good["broker_cash"] == 3.0 and good["broker_position_count"] == 1


def test_page_get_waits_as_told():
    class Answer:
        def __init__(self, code, headers=None):
            self.status_code, self.headers = code, headers or {}

    answers, waits = [Answer(429, {"Retry-After": "7"}), Answer(503), Answer(200)], []
    assert files.page_get(lambda url: answers.pop(0), "u", sleep=waits.append).status_code == 200 and waits == [7.0, 2.0]
    with pytest.raises(ValueError, match="404"):
        files.page_get(lambda url: Answer(404), "u", sleep=waits.append)


def test_control_documents(spark, tmp_path):
    path = str(tmp_path / "c" / "switch.json")
    for active in (True, False):
        broker.write_control(path, spark, {"active": active})
    assert spark.read.option("multiLine", True).json(path).first().active is False


def test_trading_rules():
    assert korea.weekday_rule("Monday-Saturday") == (0, 1, 2, 3, 4, 5) and korea.weekday_rule("tuesday / Sunday") == (1, 6)
    for bad in ("", "someday"):
        with pytest.raises(ValueError):
            korea.weekday_rule(bad)


def test_summary_of_an_empty_backtest(spark):
    assert all(v == 0 for v in metrics.summary(days(spark, [])).first())
