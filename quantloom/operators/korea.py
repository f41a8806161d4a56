"""The Korean lane: tickers, calendar, filing classes, features and selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import by_ticker, change, forward_fill, keep_last, month_ends, rolling, zscore
from quantloom.operators.backtest import Costs, run
from quantloom.operators.strategy import hold, top_n, with_history

# The first class one of whose patterns a filing's upper-cased text contains.
FILING_CLASSES = (
    ("annual_report", ("사업보고서", "ANNUAL REPORT")),
    ("semiannual_report", ("반기보고서", "SEMIANNUAL REPORT")),
    ("quarterly_report", ("분기보고서", "QUARTERLY REPORT")),
    ("earnings", ("영업(잠정)실적", "EARNINGS", "실적")),
    ("major_contract", ("단일판매", "공급계약", "MAJOR CONTRACT")),
    ("capital_event", ("유상증자", "무상증자", "전환사채", "BW", "CB", "RIGHTS OFFERING")),
    ("governance", ("주주총회", "대표이사", "임원", "이사", "감사", "GOVERNANCE", "BOARD")),
)
TIMEZONE = "Asia/Seoul"


def filing_class(*parts: Column) -> Column:
    text = F.upper(F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]))
    out = None
    for name, patterns in FILING_CLASSES:
        fits = F.lit(False)
        for p in patterns:
            fits = fits | F.contains(text, F.lit(p))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("other")


def first_given(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def listing_code(value: Column, digits: int = 6) -> Column:
    """Digits before a dot, padded with zeros; null where that is not a number of at most ``digits`` digits."""
    code = F.split_part(F.upper(F.trim(value)), F.lit("."), F.lit(1))
    return F.when(code.rlike(rf"^[0-9]{{1,{digits}}}$"), F.lpad(code, digits, "0"))


def receipt_url(receipt: Column) -> Column:
    return F.format_string("https://dart.fss.or.kr/dsaf001/main.do?rcpNo=%s", receipt)


def vendor_suffix(value: Column) -> Column:
    return F.nullif(F.split_part(F.upper(F.trim(value)), F.lit("."), F.lit(2)), F.lit(""))


def filed_at(value: Column, tz: str = TIMEZONE) -> Column:
    """An instant from an ISO text or digits of a date, with or without a time; local where no offset is given."""
    text = F.trim(value)
    offset = text.rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.contains(text, F.lit("T"))
    local = F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(text, F.lit("yyyyMMddHHmm")), F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text))
    return F.when(offset, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(local, tz))


def is_trading_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


# Names of weekdays in a trading-day rule.
WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def weekday_rule(rule: str) -> tuple[int, ...]:
    """Weekdays, Monday 0, of a rule: a span from Monday on, or names between commas or slashes; any other name is an error."""
    text = rule.strip().upper()
    if text in ("MONDAY-FRIDAY", "MONDAY-SATURDAY"):
        return tuple(range(WEEKDAYS.index(text.split("-")[1]) + 1))
    names = [x.strip() for x in text.replace("/", ",").split(",") if x.strip()]
    if not names or any(x not in WEEKDAYS for x in names):
        raise ValueError(f"not a rule of trading days: {rule}")
    return tuple(sorted({WEEKDAYS.index(x) for x in names}))


def trading_days(days: DataFrame, rule: str = "MONDAY-FRIDAY", holidays: DataFrame | None = None) -> DataFrame:
    """``days`` (column date) with is_trading: a weekday of the rule that is no holiday (column date)."""
    open_ = F.weekday("date").isin(*weekday_rule(rule))
    if holidays is None:
        return days.withColumn("is_trading", open_)
    shut = holidays.select("date").distinct().withColumn("shut", F.lit(True))
    return days.join(shut, "date", "left").withColumn("is_trading", open_ & F.col("shut").isNull()).drop("shut")


def session_window(days: DataFrame, opens: str = "09:00", closes: str = "15:30", tz: str = TIMEZONE) -> DataFrame:
    """``days`` (date, is_trading) with the instants at which the session opens and closes; null on days without one."""
    at = lambda clock: F.when(F.col("is_trading"), F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format("date", "yyyy-MM-dd "), F.lit(f"{clock}:00"))), tz))
    return days.withColumns({"opens_at": at(opens), "closes_at": at(closes)})


def epoch_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Seconds of a span of days as a chart service asks for them: the end is exclusive, so it is the day after."""
    return F.unix_date(start).cast("long") * 86400, (F.unix_date(end).cast("long") + 1) * 86400


def checked_codes(rows: DataFrame, column: str, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(rows with listing_code, vendor_suffix and ticker; rows whose code is none, with the error): no row is lost."""
    out = rows.withColumns({"listing_code": listing_code(F.col(column), digits), "vendor_suffix": vendor_suffix(F.col(column))})
    good = out.where("listing_code is not null").withColumn("ticker", F.concat_ws(".", "listing_code", "vendor_suffix"))
    why = F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "empty code").when(F.char_length(F.split_part(F.trim(column), F.lit("."), F.lit(1))) > digits, "too many digits").otherwise("not a number")
    return good, out.where("listing_code is null").drop("listing_code", "vendor_suffix").withColumn("error", why)


# Fields of a filing list by the names that they get.
LIST_FIELDS = {"rcept_no": "rcept_no", "corp_code": "corp_code", "corp_name": "corp_name", "stock_code": "stock_code", "report_nm": "report_name", "rm": "report_subtype", "rcept_dt": "receipt_datetime"}


def list_payloads(rows: DataFrame) -> DataFrame:
    """(rcept_no, payload): the named fields of list rows and the filing's url, as a map without empty ones."""
    given = [F.struct(F.lit(new).alias("key"), F.col(old).cast("string").alias("value")) for old, new in LIST_FIELDS.items() if old in rows.columns]
    url = F.struct(F.lit("source_url").alias("key"), receipt_url(F.col("rcept_no").cast("string")).alias("value"))
    full = F.filter(F.array(*given, url), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    return rows.select(F.col("rcept_no").cast("string").alias("rcept_no"), F.map_from_entries(full).alias("payload"))


# Names under which the parts of a filing may be given, the first one wins.
FILING_FIELDS = {
    "receipt_no": ("receipt_no", "rcept_no"),
    "issuer_code": ("corp_code", "issuer_code"),
    "issuer_name": ("corp_name", "issuer_name", "company_name"),
    "filing_type": ("report_name", "filing_type", "form"),
    "filing_subtype": ("report_subtype", "filing_subtype", "subcategory"),
    "title": ("report_title", "title", "headline"),
    "filed": ("receipt_datetime", "filed_at", "rcept_dt", "date"),
    "raw_ticker": ("stock_code", "listing_code", "ticker"),
    "body_text": ("body_text", "text", "document_text"),
    "source_url": ("source_url", "url", "link"),
}


def normalise_filings(payloads: DataFrame, calendar: DataFrame, column: str = "payload", close_hour: float = 15.5, tz: str = TIMEZONE) -> tuple[DataFrame, DataFrame]:
    """(filings, rejected) from maps of texts: fields by their first given name, the class, the instant and the session date.

    Rejected, with the error: filings without an issuer, without a time that
    can be read, or with a code that is no listing code.
    """
    p = F.col(column)
    picked = {name: F.nullif(F.trim(first_given(*[F.try_element_at(p, F.lit(k)) for k in keys])), F.lit("")) for name, keys in FILING_FIELDS.items()}
    out = payloads.withColumns(picked)
    out = out.withColumns(
        {
            "title": F.coalesce("title", "issuer_name"),
            "category": filing_class(F.col("filing_type"), F.col("filing_subtype"), F.coalesce("title", "issuer_name")),
            "filing_type": F.coalesce("filing_type", F.lit("UNKNOWN")),
            "filed_at": filed_at(F.col("filed"), tz),
            "listing_code": listing_code(F.col("raw_ticker")),
            "vendor_suffix": F.when(F.col("raw_ticker").isNotNull(), vendor_suffix(F.col("raw_ticker"))),
        }
    )
    error = F.when(F.col("issuer_name").isNull(), "no issuer").when(F.col("filed").isNull(), "no time").when(F.col("filed_at").isNull(), "a time that cannot be read").when(F.col("raw_ticker").isNotNull() & F.col("listing_code").isNull(), "no listing code")
    out = out.withColumn("error", error)
    good = session_dates(out.where("error is null"), calendar, "filed_at", close_hour, tz).withColumn("ticker", F.when(F.col("listing_code").isNotNull(), F.concat_ws(".", "listing_code", "vendor_suffix")))
    names = ("receipt_no", "issuer_code", "issuer_name", "ticker", "listing_code", "vendor_suffix", "filing_type", "filing_subtype", "title", "filed_at", "session_date", "category", "body_text", "source_url")
    return good.select(*names), out.where("error is not null").select(column, "error")


def corporation_codes(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, corp_code) of a file, all texts; rows without either are left out."""
    rows = spark.read.csv(path, header=True)
    if missing := sorted({"ticker", "corp_code"} - set(rows.columns)):
        raise ValueError(f"the corporation codes lack columns: {missing}")
    return rows.select(F.trim("ticker").alias("ticker"), F.trim("corp_code").alias("corp_code")).where("ticker <> '' and corp_code <> ''")


def requested_codes(codes: DataFrame, tickers: DataFrame) -> DataFrame:
    """The corporation codes of the requested tickers."""
    return codes.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def research_bundle(bars: Sequence[DataFrame], benchmark: DataFrame | None, filings: Sequence[DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """prices (the bars of all tickers), benchmark_prices and filings of a run, and counts: one row of how many there are of each."""
    both = lambda fs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fs)
    prices = both(bars)
    none = prices.limit(0)
    found = {"prices": prices, "benchmark_prices": none if benchmark is None else benchmark, "filings": both(filings) if filings else None}
    counts = asked.agg(F.count_distinct("ticker").alias("ticker_count"))
    for name, frame in found.items():
        n = frame.agg(F.count("*").alias(f"{name}_rows")) if frame is not None else asked.sparkSession.range(1).select(F.lit(0).cast("long").alias(f"{name}_rows"))
        counts = counts.join(n, how="cross")
    return {k: v for k, v in found.items() if v is not None} | {"counts": counts}


@dataclass(frozen=True)
class Market:
    """Settings of a market; fees are kept for reports, backtests take their own."""

    name: str
    timezone: str
    regular_open: str
    regular_close: str
    trading_days: str
    listing_code_digits: int
    commission_bps: float
    tax_bps: dict[str, float]
    min_close_price: int


def load_market(folder: str | Path) -> Market:
    """Settings from the YAML files market_assumptions, fees_tax, trading_calendar and ticker_conventions of a folder; a missing key is an error."""
    import yaml

    read = lambda name: yaml.safe_load((Path(folder) / f"{name}.yaml").read_text()) or {}
    market, fees, calendar, codes = (read(n) for n in ("market_assumptions", "fees_tax", "trading_calendar", "ticker_conventions"))
    return Market(
        str(market["market"]["name"]),
        str(market["market"]["timezone"]),
        str(market["sessions"]["regular_open"]),
        str(market["sessions"]["regular_close"]),
        str(calendar["calendar"]["regular_trading_days"]),
        int(codes["formats"]["listing_code_digits"]),
        float(fees["commission"]["per_side_bps"]),
        {str(k): float(v) for k, v in fees["tax"]["securities_transaction_tax_bps"].items()},
        int(market["eligibility"]["min_close_price"]),
    )


def session_dates(filings: DataFrame, calendar: DataFrame, at: str = "filed_at", close_hour: float = 15.5, tz: str = TIMEZONE) -> DataFrame:
    """``filings`` with session_date: the local day, the next one after the close, rolled on to a trading day.

    ``calendar``: trading days in column date. The days asked for are looked up
    together with the calendar in one window over days, not over filings.
    """
    local = F.from_utc_timestamp(F.col(at), tz)
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    day = F.when(seconds > int(close_hour * 3600), F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
    asked = filings.withColumn("__day", day)
    days = asked.select(F.col("__day").alias("d"), F.lit(None).cast("date").alias("t")).distinct()
    both = days.unionAll(calendar.select(F.col("date").alias("d"), F.col("date").alias("t")).distinct())
    ahead = Window.orderBy(F.col("d"), F.col("t").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    rolled = both.withColumn("session_date", F.first("t", ignorenulls=True).over(ahead)).where("t is null").select(F.col("d").alias("__day"), "session_date")
    return asked.join(rolled, "__day", "left").drop("__day")


def filing_counts(filings: DataFrame) -> DataFrame:
    kinds = {"earnings_filing_count": "earnings", "capital_event_count": "capital_event", "governance_filing_count": "governance"}
    return filings.groupBy(F.col("session_date").alias("date"), F.upper("ticker").alias("ticker")).agg(
        F.count("*").cast("double").alias("filing_count"), *[F.count_if(F.lower("category") == v).cast("double").alias(k) for k, v in kinds.items()]
    )


def benchmark_signals(benchmark: DataFrame) -> DataFrame:
    w = Window.orderBy("date")
    close = F.col("close")
    out = keep_last(benchmark.select("date", "close"), ["date"], [close.desc_nulls_last()]).withColumn("__p", forward_fill(close, w))
    for k in (1, 5, 20):
        out = out.withColumn(f"benchmark_ret_{k}", change(F.col("__p"), k, w))
    return out.select(
        "date",
        close.alias("benchmark_close"),
        "benchmark_ret_1",
        "benchmark_ret_5",
        "benchmark_ret_20",
        rolling(F.stddev_samp, F.col("benchmark_ret_1"), 20, 5, w).alias("benchmark_vol_20"),
        F.coalesce(close >= rolling(F.avg, close, 20, 1, w), F.lit(True)).cast("double").alias("market_trend_ok"),
    )


def build_features(prices: DataFrame, filings: DataFrame | None = None, benchmark: DataFrame | None = None) -> DataFrame:
    """Price, benchmark and filing features; without filings counts are 0 and the last one was 9999 days ago."""
    w, close = by_ticker(), F.col("close")
    out = prices.withColumn("ticker", F.upper("ticker")).withColumn("__p", forward_fill(close))
    for k in (1, 5, 20):
        out = out.withColumn(f"ret_{k}", change(F.col("__p"), k))
    out = out.drop("__p").withColumns({"dollar_volume": close * F.col("volume"), "intraday_range": F.try_divide(F.col("high") - F.col("low"), close)})
    out = out.withColumns(
        {
            "avg_dollar_volume_20": rolling(F.avg, F.col("dollar_volume"), 20, 1),
            "vol_20": rolling(F.stddev_samp, F.col("ret_1"), 20, 5),
            "range_20": rolling(F.avg, F.col("intraday_range"), 20, 1),
        }
    )
    defaults = {"benchmark_ret_1": 0.0, "benchmark_ret_5": 0.0, "benchmark_ret_20": 0.0, "benchmark_vol_20": 0.0, "market_trend_ok": 1.0}
    if benchmark is not None:
        out = out.join(benchmark_signals(benchmark), "date", "left").fillna(defaults)
    else:
        out = out.withColumns({"benchmark_close": F.lit(None).cast("double"), **{k: F.lit(v) for k, v in defaults.items()}})
    out = out.withColumns({f"rel_ret_{k}": F.coalesce(f"ret_{k}", F.lit(0.0)) - F.col(f"benchmark_ret_{k}") for k in (1, 5, 20)})
    counts = ["filing_count", "earnings_filing_count", "capital_event_count", "governance_filing_count"]
    if filings is not None:
        out = out.join(filing_counts(filings), ["date", "ticker"], "left").fillna(0.0, counts)
    else:
        out = out.withColumns({c: F.lit(0.0) for c in counts})
    last = F.last(F.when(F.col("filing_count") > 0, F.col("date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns(
        {
            "filing_count_20": rolling(F.sum, F.col("filing_count"), 20, 1),
            "earnings_filing_count_60": rolling(F.sum, F.col("earnings_filing_count"), 60, 1),
            "capital_event_count_60": rolling(F.sum, F.col("capital_event_count"), 60, 1),
            "days_since_last_filing": F.coalesce(F.datediff("date", last).cast("double"), F.lit(9999.0)),
        }
    )


@dataclass(frozen=True)
class Rules:
    top_n: int = 3
    min_history: int = 20
    hold_between_rebalances: bool = False


def rank_monthly(features: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Names with history and returns, by the five-term score; ties by dollar volume."""
    fit = with_history(features, rules.min_history).join(month_ends(features), "date", "left_semi")
    fit = fit.where("enough_history and ret_20 is not null and ret_5 is not null and vol_20 is not null")
    day = Window.partitionBy("date")
    terms = {"ret_20": 1.0, "ret_5": 0.35, "vol_20": -0.25, "earnings_filing_count_60": 0.30, "capital_event_count_60": -0.20}
    score = sum((zscore(F.col(c), day) * k for c, k in terms.items()), F.lit(0.0))
    return top_n(fit.withColumn("score", score), "score", rules.top_n, (F.col("avg_dollar_volume_20").desc(),)).select("date", "ticker", "score", "rank", "weight")


def target_weights(features: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return hold(rank_monthly(features, rules), features, rules.hold_between_rebalances)


def research_backtest(prices: DataFrame, filings: DataFrame | None = None, benchmark: DataFrame | None = None, rules: Rules = Rules(hold_between_rebalances=True), costs: Costs = Costs()) -> DataFrame:
    """One row a date: the backtest, with costs, of the weights that the features of these bars and filings give."""
    weights = target_weights(build_features(prices, filings, benchmark), rules)
    return run(prices.withColumn("ticker", F.upper("ticker")), weights, costs, benchmark)


CHART = "struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>,meta:struct<exchangeTimezoneName:string,currency:string>>>>>"


def chart_bars(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Bars from chart JSON: parallel arrays zipped, days in the exchange's time zone, rows with a gap left out."""
    one = payloads.withColumn("r", F.from_json(column, CHART)["chart"]["result"][0])
    q, adj = F.col("r.indicators.quote")[0], F.col("r.indicators.adjclose")[0]["adjclose"]
    parts = {"ts": F.col("r.timestamp"), **{c: q[c] for c in ("open", "high", "low", "close", "volume")}, "adj_close": F.coalesce(adj, q["close"])}
    keep = [c for c in payloads.columns if c != column]
    rows = one.select(*keep, F.coalesce(F.col("r.meta.exchangeTimezoneName"), F.lit(TIMEZONE)).alias("exchange_timezone"), F.col("r.meta.currency").alias("currency"), F.inline(F.arrays_zip(*[v.alias(k) for k, v in parts.items()])).alias(*parts))
    return rows.dropna(subset=list(parts)).withColumn("date", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("ts"), F.col("exchange_timezone")))).drop("ts")
