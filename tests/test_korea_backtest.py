"""The Korean backtest: features, weights held between month ends, returns and costs."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quantloom.operators import backtest, korea
from quantloom.plans import registry

SF = "/root/testdata/sf0.01"


def test_held_weights_earn_and_cost(spark):
    rng = np.random.default_rng(3)
    days = [d for d in (dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(121)) if d.weekday() < 5]
    close = {t: 100 * np.cumprod(1 + rng.normal(0, 0.02, len(days))) for t in "ABCDE"}
    rows = [(d, t, float(c[i]), float(c[i]), float(c[i]), 10.0) for t, c in close.items() for i, d in enumerate(days)]
    prices = spark.createDataFrame(rows, "date date, ticker string, close double, high double, low double, volume double")
    rules = korea.Rules(2, 10, True)
    got = {r.date: r for r in korea.research_backtest(prices, rules=rules, costs=backtest.Costs(10, 5)).collect()}
    chosen = {}
    for r in korea.rank_monthly(korea.build_features(prices), rules).collect():
        chosen.setdefault(r.date, {})[r.ticker] = r.weight
    assert len(chosen) >= 3 and all(len(v) == 2 for v in chosen.values())
    now = {}
    for i, d in enumerate(days):
        gross = sum(w * (close[t][i] / close[t][i - 1] - 1) for t, w in now.items()) if i else 0.0
        new = chosen.get(d, now)
        turnover = sum(abs(new.get(t, 0) - now.get(t, 0)) for t in close)
        assert got[d].gross_return == pytest.approx(gross, abs=1e-12)
        assert got[d].turnover == pytest.approx(turnover, abs=1e-12)
        assert got[d].net_return == pytest.approx(gross - turnover * 0.0015, abs=1e-12)
        now = new
    assert sum(abs(r.gross_return) > 0 for r in got.values()) > 40


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    for t in ("events",):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = registry.QUERIES["q38_kr_research_backtest"](spark, SF)
    want = {r[0]: r for r in db.sql(registry.ORACLE_SQL["q38_kr_research_backtest"]).fetchall()}
    rows = out.orderBy("date").collect()
    assert len(rows) == len(want) == 30 and out.where(F.col("turnover") > 0).count() > 0
    for r in rows:
        assert tuple(r)[1:] == pytest.approx(want[r.date][1:], abs=2e-6)
