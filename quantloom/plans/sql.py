"""The research dataflow as DuckDB common table expressions, for the oracles."""

from __future__ import annotations

import re

from quantloom.sources import panel


def roll(fn: str, x: str, n: int, least: int | None = None, part: str = "PARTITION BY ticker ") -> str:
    w = f"OVER ({part}ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {fn}({x}) {w} END"


def ret(x: str, k: int, part: str = "PARTITION BY ticker ") -> str:
    return f"{x} / nullif(lag({x}, {k}) OVER ({part}ORDER BY date), 0) - 1"


def z(x: str, part: str) -> str:
    w = f"OVER (PARTITION BY {part})"
    return f"CASE WHEN coalesce(stddev_pop({x}) {w}, 0) = 0 THEN 0 ELSE ({x} - avg({x}) {w}) / stddev_pop({x}) {w} END"


def pct(x: str, part: str) -> str:
    n = f"count({x}) OVER (PARTITION BY {part})"
    return (
        f"CASE WHEN {n} <= 1 THEN 0.5 WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST)"
        f" + (count({x}) OVER (PARTITION BY {part}, {x}) - 1) / 2e0) / {n} END"
    )


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) AS {name or x}"


def half_up(sql: str) -> str:
    """Every round(x, k) as floor(x * 10**k + 0.5) / 10**k, which both engines compute alike."""
    while m := re.search(r"\bround\(", sql):
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        x, _, k = sql[m.end() : at - 1].rpartition(",")
        sql = f"{sql[: m.start()]}floor(({x}) * 1e{int(k)} + 0.5e0) / 1e{int(k)}{sql[at:]}"
    return sql


_ALL = ""
TABLES: dict[str, str] = {
    **panel.SQL,
    "prices_returns": f"""SELECT *, close * volume AS dollar_volume, (high - low) / nullif(close, 0) AS range_pct,
        {ret("close", 1)} AS ret_1, {ret("close", 5)} AS ret_5, {ret("close", 20)} AS ret_20, {ret("close", 60)} AS ret_60, {ret("close", 120)} AS ret_120
        FROM prices""",
    "prices_rolled": f"""SELECT *, {roll("stddev_samp", "ret_1", 20)} AS vol_20, {roll("stddev_samp", "ret_1", 60)} AS vol_60,
        {roll("avg", "close", 20)} AS sma_20, {roll("avg", "close", 50)} AS sma_50, {roll("avg", "close", 200)} AS sma_200,
        close / nullif({roll("max", "close", 20)}, 0) - 1 AS drawdown_20, close / nullif({roll("max", "close", 60)}, 0) - 1 AS drawdown_60,
        {roll("avg", "dollar_volume", 20)} AS dollar_volume_20, volume / nullif({roll("avg", "volume", 20)}, 0) - 1 AS volume_ratio_20,
        {roll("avg", "range_pct", 20)} AS range_pct_20 FROM prices_returns""",
    "price_feats": """SELECT *, close / nullif(sma_20, 0) - 1 AS price_vs_sma20, close / nullif(sma_50, 0) - 1 AS price_vs_sma50,
        close / nullif(sma_200, 0) - 1 AS price_vs_sma200, sma_20 / nullif(sma_50, 0) - 1 AS sma20_vs_sma50, sma_50 / nullif(sma_200, 0) - 1 AS sma50_vs_sma200,
        ln(1 + dollar_volume_20) AS log_dollar_volume_20, vol_20 / nullif(vol_60, 0) - 1 AS vol_ratio_20_60, ret_20 - ret_60 AS momentum_20_60_gap,
        coalesce(close > sma_50 AND sma_50 > sma_200, false) AS trend_ok FROM prices_rolled""",
    "bench_returns": f"""SELECT *, {ret("close", 1, _ALL)} AS benchmark_ret_1, {ret("close", 20, _ALL)} AS benchmark_ret_20, {ret("close", 60, _ALL)} AS benchmark_ret_60
        FROM benchmark_bars""",
    "bench_rolled": f"""SELECT *, {roll("stddev_samp", "benchmark_ret_1", 20, part=_ALL)} AS benchmark_vol_20, {roll("avg", "close", 50, part=_ALL)} AS bs50,
        {roll("avg", "close", 200, part=_ALL)} AS bs200, close / nullif({roll("max", "close", 60, part=_ALL)}, 0) - 1 AS benchmark_drawdown_60 FROM bench_returns""",
    "bench_feats": f"""SELECT date, benchmark_ret_1, benchmark_ret_20, benchmark_ret_60, benchmark_vol_20, benchmark_drawdown_60,
        close / nullif(bs200, 0) - 1 AS benchmark_price_vs_sma200, bs50 / nullif(bs200, 0) - 1 AS benchmark_sma50_vs_sma200,
        coalesce(close > bs50 AND bs50 > bs200, false) AS market_trend_ok,
        coalesce(benchmark_vol_20 > {roll("avg", "benchmark_vol_20", 60, part=_ALL)}, false) AS market_high_vol_regime FROM bench_rolled""",
    "ends": "SELECT max(date) AS date FROM prices GROUP BY date_trunc('month', date)",
    "liquid": f"""SELECT *, {roll("avg", "close * volume", 60)} AS avg_dollar_volume_60,
        CAST(date_diff('day', min(date) OVER (PARTITION BY ticker), date) AS DOUBLE) AS universe_age_days FROM prices""",
    "snapshots": """SELECT date AS effective_date, ticker, selection_rank, avg_dollar_volume_60, close, universe_age_days FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY avg_dollar_volume_60 DESC, ticker) AS selection_rank FROM liquid
        WHERE date IN (SELECT date FROM ends) AND coalesce(close, 0) >= 5 AND coalesce(avg_dollar_volume_60, 0) >= 1000 AND universe_age_days >= 252)
        WHERE selection_rank <= 30""",
    "snap_dates": "SELECT start, lead(start) OVER (ORDER BY start) AS until FROM (SELECT DISTINCT effective_date AS start FROM snapshots)",
    "in_universe": """SELECT p.* FROM (SELECT p.*, coalesce(m.sector, 'UNKNOWN') AS sector, m.industry, b.* EXCLUDE (date)
            FROM price_feats p LEFT JOIN metadata m USING (ticker) LEFT JOIN bench_feats b USING (date)) p
        JOIN snap_dates d ON p.date >= d.start AND (d.until IS NULL OR p.date < d.until)
        JOIN snapshots s ON s.effective_date = d.start AND s.ticker = p.ticker""",
    "relative": """SELECT *, ret_20 - benchmark_ret_20 AS rel_ret_20, ret_60 - benchmark_ret_60 AS rel_ret_60, benchmark_ret_20 - benchmark_ret_60 AS benchmark_momentum_gap,
        min(date) OVER (PARTITION BY ticker) AS first_universe_date FROM in_universe""",
    "feats": f"""SELECT *, rel_ret_20 - rel_ret_60 AS relative_momentum_gap, CAST(date_diff('day', first_universe_date, date) AS DOUBLE) AS universe_age_days,
        {z("ret_20", "date")} AS cs_ret_20_z, {z("ret_60", "date")} AS cs_ret_60_z, {z("rel_ret_20", "date")} AS cs_rel_ret_20_z, {z("vol_20", "date")} AS cs_vol_20_z,
        {pct("rel_ret_20", "date")} AS universe_momentum_rank_pct, {pct("vol_20", "date")} AS universe_vol_rank_pct,
        avg(CAST(trend_ok AS DOUBLE)) OVER (PARTITION BY date) AS market_breadth_trend_share, count(*) OVER s AS sector_size,
        ret_20 - avg(ret_20) OVER s AS sector_ret_20_gap, rel_ret_20 - avg(rel_ret_20) OVER s AS sector_rel_ret_20_gap, vol_20 - avg(vol_20) OVER s AS sector_vol_20_gap,
        {pct("rel_ret_20", "date, sector")} AS sector_momentum_rank_pct, avg(CAST(trend_ok AS DOUBLE)) OVER s AS sector_trend_share,
        coalesce(close, 0) >= 5 AND coalesce(dollar_volume_20, 0) >= 1000 AND date_diff('day', first_universe_date, date) >= 30 AS eligible_universe
        FROM relative WINDOW s AS (PARTITION BY date, sector)""",
    "scored": """SELECT f.*, coalesce(s.llm_score, 0) AS llm_score, row_number() OVER (PARTITION BY f.ticker ORDER BY f.date) >= 20 AS enough_history
        FROM feats f ASOF LEFT JOIN (SELECT * FROM signals WHERE horizon_bucket = 'short') s ON f.ticker = s.ticker AND f.date >= s.date""",
    "fit": """SELECT * FROM scored WHERE date IN (SELECT max(date) FROM feats GROUP BY date_trunc('month', date)) AND eligible_universe AND enough_history
        AND ret_20 IS NOT NULL AND ret_60 IS NOT NULL AND vol_20 IS NOT NULL""",
    "chosen": f"""SELECT date, ticker, score, rank, 1e0 / count(*) OVER (PARTITION BY date) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank FROM (
            SELECT date, ticker, {z("ret_20", "date")} * 0.45e0 + {z("ret_60", "date")} * 0.35e0 + {z("vol_20", "date")} * -0.20e0 + {z("llm_score", "date")} * 0.10e0
                - CAST(NOT trend_ok AS DOUBLE) * 0.35e0 AS score FROM fit)) WHERE rank <= 4""",
    "weights": """SELECT date, ticker, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS weight FROM (
        SELECT d.date, t.ticker, CASE WHEN d.date IN (SELECT max(date) FROM feats GROUP BY date_trunc('month', date)) THEN coalesce(c.weight, 0) END AS w
        FROM (SELECT DISTINCT date FROM feats) d CROSS JOIN (SELECT DISTINCT ticker FROM feats) t LEFT JOIN chosen c ON c.date = d.date AND c.ticker = t.ticker)""",
    "carried": """SELECT date, ticker, close, dollars, coalesce(last_value(w IGNORE NULLS) OVER o, 0) AS weight,
        last_value(close IGNORE NULLS) OVER o AS padded FROM (
        SELECT d.date, t.ticker, p.close, coalesce(p.close, 0) * coalesce(p.volume, 0) AS dollars, w.weight AS w
        FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT ticker FROM prices) t
        LEFT JOIN prices p ON p.date = d.date AND p.ticker = t.ticker LEFT JOIN weights w ON w.date = d.date AND w.ticker = t.ticker)
        WINDOW o AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "limited": """SELECT * REPLACE (CASE WHEN total > 0.96e0 THEN cut * 0.96e0 / total ELSE cut END AS weight) FROM (
        SELECT *, least(0.02e0, greatest(0, weight)) AS cut, sum(least(0.02e0, greatest(0, weight))) OVER (PARTITION BY date) AS total FROM carried)""",
    "moves": """SELECT date, ticker, live, abs(weight - live) AS change, ret, CASE WHEN usual > 0 THEN usual ELSE dollars END AS liquidity FROM (
        SELECT *, lag(weight, 1, 0) OVER o AS live, coalesce(padded / nullif(lag(padded) OVER o, 0) - 1, 0) AS ret,
        avg(dollars) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual FROM limited WINDOW o AS (PARTITION BY ticker ORDER BY date))""",
    "days": """SELECT row_number() OVER (ORDER BY date) AS k, * FROM (SELECT date, sum(live * ret) AS gross_return, sum(change) AS turnover,
        coalesce(sum(CASE WHEN change > 0 AND liquidity > 0 THEN change * pow(change / liquidity, 0.5e0) END), 0) * 0.0015e0 AS unit,
        coalesce(sum(CASE WHEN change > 0 AND liquidity <= 0 THEN change END), 0) * 0.0015e0 AS flat,
        coalesce(max(CASE WHEN change > 0 AND liquidity > 0 THEN change / liquidity END), 0) AS part_unit,
        max(CASE WHEN change > 0 AND liquidity <= 0 THEN 1e0 ELSE 0e0 END) AS part_flat FROM moves GROUP BY date)""",
    "path": """SELECT k, date, gross_return, turnover, turnover * 0.001e0 AS linear_cost, turnover * 0.0005e0 AS spread_cost, pow(100e0, 0.5e0) * unit + flat AS impact_cost,
            greatest(100e0 * part_unit, part_flat) AS max_participation,
            100e0 * (1 + gross_return - turnover * 0.0015e0 - (pow(100e0, 0.5e0) * unit + flat)) AS value FROM days WHERE k = 1
        UNION ALL
        SELECT d.k, d.date, d.gross_return, d.turnover, d.turnover * 0.001e0, d.turnover * 0.0005e0, pow(p.value, 0.5e0) * d.unit + d.flat,
            greatest(p.value * d.part_unit, d.part_flat),
            p.value * (1 + d.gross_return - d.turnover * 0.0015e0 - (pow(p.value, 0.5e0) * d.unit + d.flat)) FROM path p JOIN days d ON d.k = p.k + 1""",
    "bench_ret": "SELECT date, coalesce(close / nullif(lag(close) OVER (ORDER BY date), 0) - 1, 0) AS benchmark_return FROM benchmark_bars",
    "bt": """SELECT p.*, gross_return - linear_cost - spread_cost - impact_cost AS net_return, coalesce(b.benchmark_return, 0) AS benchmark_return
        FROM path p LEFT JOIN bench_ret b USING (date)""",
    "curves": """SELECT *, product(1 + net_return) OVER o AS equity, product(1 + gross_return) OVER o AS gross_equity, product(1 + benchmark_return) OVER o AS benchmark_equity
        FROM bt WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "drawn": "SELECT *, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curves",
}


def with_tables(select: str, **more: str) -> str:
    """``select`` after the tables that it needs; ``more`` adds or replaces some."""
    tables = {**TABLES, **more}

    def needs(text: str) -> list[str]:
        return [t for t in tables if re.search(rf"(?:FROM|JOIN)\s+{t}\b", text)]

    used: list[str] = []

    def add(name: str) -> None:
        if name in used:
            return
        for t in needs(tables[name]):
            if t != name:
                add(t)
        used.append(name)

    for t in needs(select):
        add(t)
    # A table that many others read is computed once.
    if not used:
        return select
    return f"WITH RECURSIVE {', '.join(f'{t} AS {"" if t == "path" else "MATERIALIZED "}({tables[t]})' for t in used)} {select}"
