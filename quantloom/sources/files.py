"""Readers, writers, caches and manifests of the research files.

What talks to a network takes its client as a parameter; nothing here opens a
connection of its own.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.windows import keep_last

# Answers after which a service may be asked again.
BUSY = (429, 500, 502, 503, 504)
PRICE_COLUMNS = ("date", "ticker", "open", "high", "low", "close", "volume")
PRICE_SCHEMA = T.StructType([T.StructField("date", T.StringType()), T.StructField("ticker", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS[2:]]])


def require_columns(frame: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    if missing := sorted(set(names) - set(frame.columns)):
        raise ValueError(f"{what} is missing columns: {missing}")
    return frame


def normalise_columns(frame: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Lower-case names with underscores, after ``renames``."""
    own = {c: (renames or {}).get(c, c).strip().lower().replace(" ", "_") for c in frame.columns}
    return frame.withColumnsRenamed(own)


def _day(c: str) -> Column:
    return F.coalesce(F.try_to_timestamp(F.col(c).cast("string")), F.try_to_timestamp(F.col(c).cast("string"), F.lit("yyyy-MM-dd"))).cast("date")


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    require_columns(raw, PRICE_COLUMNS, "prices")
    return raw.select(_day("date").alias("date"), F.upper(F.trim("ticker")).alias("ticker"), *[F.col(c).try_cast("double").alias(c) for c in PRICE_COLUMNS[2:]])


def save_table(frame: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = frame.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def known_name(name: Column) -> Column:
    """A name without blanks around it; UNKNOWN for an empty one."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("UNKNOWN"))


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, sector, industry): unknown sectors named so, one row a ticker."""
    raw = require_columns(spark.read.csv(path, header=True), ("ticker", "sector"), "metadata")
    named = lambda c: known_name(F.col(c)).alias(c) if c in raw.columns else F.lit("UNKNOWN").alias(c)
    return keep_last(raw.select(F.upper(F.trim("ticker")).alias("ticker"), named("sector"), named("industry")), ["ticker"], [F.col("sector"), F.col("industry")])


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    raw = require_columns(spark.read.csv(path, header=True), ("effective_date", "ticker"), "universe snapshots")
    return raw.select(_day("effective_date").alias("effective_date"), F.upper(F.trim("ticker")).alias("ticker")).dropDuplicates().orderBy("effective_date", "ticker")


def load_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a text file: comments after #, separated by commas or blanks, each once in order of its first place."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    words = lines.select("line", F.posexplode(F.split(F.split_part("value", F.lit("#"), F.lit(1)), r"[,\s]+")).alias("pos", "ticker")).where("ticker <> ''")
    first = words.groupBy(F.upper("ticker").alias("ticker")).agg(F.min(F.struct("line", "pos")).alias("at"))
    return first.orderBy("at").select("ticker")


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    raw = require_columns(spark.read.csv(path, header=True), ("date", "ticker", "llm_score"), "scores")
    rest = [c for c in raw.columns if c not in ("date", "ticker", "llm_score")]
    return raw.select(_day("date").alias("date"), F.upper(F.trim("ticker")).alias("ticker"), F.col("llm_score").try_cast("double").alias("llm_score"), *rest).dropna(subset=["date", "ticker", "llm_score"])


def load_documents(spark: SparkSession, path: str, defaults: Mapping[str, str] | None = None) -> DataFrame:
    raw = require_columns(spark.read.csv(path, header=True, multiLine=True, escape='"'), ("date", "ticker", "title", "text"), "documents")
    own = {"doc_type": "filing", "source": "", "form": "", "section_type": "", **(defaults or {})}
    out = raw.withColumns({"date": _day("date"), "ticker": F.upper(F.trim("ticker")), "text": F.coalesce("text", F.lit("")), "title": F.coalesce("title", F.lit(""))})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in raw.columns else F.lit(v) for c, v in own.items()})


def load_positions(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, shares); a path without a file is an empty portfolio."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "ticker string, shares double")
    raw = require_columns(spark.read.csv(path, header=True), ("ticker", "shares"), "positions")
    return raw.select(F.upper(F.trim("ticker")).alias("ticker"), F.coalesce(F.col("shares").try_cast("double"), F.lit(0.0)).alias("shares"))


def frame_summary(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("row_count"), F.count_distinct("ticker").alias("ticker_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def recent_rows(payloads: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """Rows from a JSON struct of parallel arrays under filings.recent."""
    schema = f"filings struct<recent:struct<{','.join(f'{k}:array<string>' for k in fields)}>>"
    parsed = payloads.withColumn("__r", F.from_json(column, schema)["filings"]["recent"])
    keep = [c for c in payloads.columns if c != column]
    return parsed.select(*keep, F.inline(F.arrays_zip(*[F.col(f"__r.{k}") for k in fields])).alias(*fields.values()))


def append_records(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Adds rows to a ledger of JSON lines."""
    records.write.mode("append").json(path)


# --- manifests and caches ---------------------------------------------------


def plain(value: Any) -> Any:
    """What JSON can hold: dates as ISO texts, data classes as dictionaries, NaN as null."""
    if is_dataclass(value) and not isinstance(value, type):
        value = asdict(value)
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in (sorted(value) if isinstance(value, set) else value)]
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, float) and value != value:
        return None
    return str(value) if isinstance(value, Path) else value


def stable_json(value: Any) -> str:
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def payload_digest(value: Any) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


def file_digest(path: str | Path) -> str | None:
    p = Path(path)
    return hashlib.sha256(p.read_bytes()).hexdigest() if p.is_file() else None


def frame_digest(frame: DataFrame) -> str:
    """A digest of the rows, whatever their order: the sum of row hashes and their number."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = frame.agg(F.sum(h).alias("h"), F.count("*").alias("n")).first()
    return payload_digest([str(r["h"]), r["n"]])


def same_inputs(old: Mapping[str, Any], new: Mapping[str, Any]) -> bool:
    """Whether two signatures describe the same inputs: paths may differ, existence and digests may not."""
    strip = lambda m: {k: {x: v.get(x) for x in ("exists", "sha256")} if isinstance(v, Mapping) else v for k, v in m.items()}
    return strip(old) == strip(new)


@dataclass(frozen=True)
class Cached:
    frame: DataFrame
    reused: bool


def cached_table(spark: SparkSession, root: str, signature: Mapping[str, Any], build: Callable[[], DataFrame], refresh: bool = False) -> Cached:
    """The table stored under the signature's digest, built and stored first where it is missing."""
    path = f"{root.rstrip('/')}/{payload_digest(signature)[:24]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if refresh or not exists:
        build().write.mode("overwrite").parquet(path)
    return Cached(spark.read.parquet(path), exists and not refresh)


def run_manifest(name: str, config: Any, inputs: Sequence[str] = (), extra: Mapping[str, Any] | None = None) -> dict[str, Any]:
    described = {str(p): {"exists": Path(p).is_file(), "sha256": file_digest(p)} for p in inputs}
    return {"name": name, "config": plain(config), "config_sha256": payload_digest(config), "git": git_state(Path.cwd()), "inputs": described, **plain(extra or {})}


def save_manifest(manifest: Mapping[str, Any], path: str | Path, outputs: Sequence[str] = ()) -> dict[str, Any]:
    whole = {**plain(manifest), "outputs": {str(o): file_digest(o) for o in outputs}}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(whole, sort_keys=True, indent=2))
    return whole


def save_artifacts(root: str, tables: Mapping[str, DataFrame], fmt: str = "parquet") -> dict[str, str]:
    """Writes each named table under the root; returns the paths."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in tables}
    for name, frame in tables.items():
        save_table(frame, paths[name], fmt)
    return paths


def save_research(root: str, features: DataFrame, ranking: DataFrame, weights: DataFrame, equity: DataFrame, summary: DataFrame, fmt: str = "csv", **more: DataFrame) -> dict[str, str]:
    """Writes the tables of a research run under their standing names; returns the paths."""
    return save_artifacts(root, {"features": features, "ranking_history": ranking, "target_weights": weights, "equity_curve": equity, "summary": summary, **more}, fmt)


def load_report(spark: SparkSession, path: str, dates: Sequence[str] = ("date", "eval_start", "eval_end")) -> DataFrame:
    """A report's table: its date columns as dates, what looks like a number as one."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    return raw.withColumns({c: F.to_date(c) for c in dates if c in raw.columns})


def of_ticker(frame: DataFrame, ticker: str, start: str | None = None, end: str | None = None, horizon: str | None = None) -> DataFrame:
    """A ticker's rows from start to end, of one horizon if the table tells them apart, in order of date and title."""
    out = frame.where(F.upper("ticker") == ticker.upper())
    if start is not None:
        out = out.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        out = out.where(F.col("date") <= F.to_date(F.lit(end)))
    if horizon is not None and "horizon_bucket" in frame.columns:
        out = out.where(F.col("horizon_bucket") == horizon)
    return out.orderBy("date", *[c for c in ("title",) if c in frame.columns])


def git_state(root: str | Path) -> dict[str, Any]:
    """Branch, commit and whether files have changed; nulls outside of a repository."""
    import subprocess

    def ask(*words: str) -> str | None:
        got = subprocess.run(["git", "-C", str(root), *words], capture_output=True, text=True, check=False)
        return got.stdout.strip() if got.returncode == 0 else None

    status = ask("status", "--porcelain")
    return {"branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "commit": ask("rev-parse", "HEAD"), "dirty": None if status is None else bool(status)}


@dataclass(frozen=True)
class MarketData:
    """What a run reads, and where it came from."""

    prices: DataFrame
    benchmark: DataFrame
    metadata: DataFrame | None
    snapshots: DataFrame | None
    provenance: dict[str, Any]


def market_data(
    spark: SparkSession,
    root: str,
    tickers: Sequence[str],
    benchmark: str,
    start: str,
    end: str | None,
    fetch: Callable[[str], Iterable[tuple]],
    metadata_file: str | None = None,
    snapshots_file: str | None = None,
    prefer_cache: bool = True,
) -> MarketData:
    """Prices and benchmark, stored under the digest of what was asked and of the files beside it, and read again where nothing of that changed.

    The manifest beside them names the query, the inputs' digests, the source
    (cache or download) and the rows, tickers and dates of both tables.
    """
    inputs = {k: {"path": v, "exists": v is not None and Path(v).is_file(), "sha256": file_digest(v) if v else None} for k, v in (("metadata_file", metadata_file), ("snapshots_file", snapshots_file))}
    query = {"tickers": list(tickers), "benchmark": benchmark, "start": start, "end": end}
    sign = {"query": query, "inputs": {k: {x: v[x] for x in ("exists", "sha256")} for k, v in inputs.items()}}
    own = cached_table(spark, f"{root}/prices", sign, lambda: download_prices(spark, tickers, fetch), not prefer_cache)
    other = cached_table(spark, f"{root}/benchmark", sign, lambda: download_prices(spark, [benchmark], fetch), not prefer_cache)
    describe = lambda f: plain(frame_summary(f).first().asDict())
    provenance = {"source": "cache" if own.reused and other.reused else "download", "query": query, "inputs": inputs, "prices_summary": describe(own.frame), "benchmark_summary": describe(other.frame)}
    tables = (load_metadata(spark, metadata_file) if metadata_file else None), (load_snapshots(spark, snapshots_file) if snapshots_file else None)
    return MarketData(own.frame, other.frame, *tables, provenance)


def refresh_market_data(spark: SparkSession, root: str, manifest_path: str | Path, config: Any, **asked: Any) -> MarketData:
    """``market_data`` downloaded anew (unless prefer_cache is given), with a manifest of the run."""
    got = market_data(spark, root, **{"prefer_cache": False, **asked})
    found = got.provenance
    extra = {"market_data_source": found["source"], "latest_market_date": found["prices_summary"]["max_date"], "price_rows": found["prices_summary"]["row_count"], "benchmark_rows": found["benchmark_summary"]["row_count"]}
    save_manifest(run_manifest("refresh_market_data", config, extra=extra), manifest_path)
    return got


def promote(source: str | Path, destination: str | Path, manifest: str) -> Path:
    """Copies a run's folder and rewrites its manifest's output paths and digests to the copies; a missing manifest is an error."""
    import shutil

    source, destination = Path(source), Path(destination)
    if not (source / manifest).is_file():
        raise FileNotFoundError(f"no manifest to promote: {source / manifest}")
    shutil.copytree(source, destination, dirs_exist_ok=True)
    whole = json.loads((destination / manifest).read_text())
    moved = [str(destination / Path(p).relative_to(source)) if Path(p).is_relative_to(source) else p for p in whole.get("outputs", {})]
    save_manifest({k: v for k, v in whole.items() if k != "outputs"}, destination / manifest, moved)
    return destination / manifest


def load_env(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines, with comments and quotes."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines() if Path(path).is_file() else []:
        key, found, value = line.strip().removeprefix("export ").partition("=")
        if found and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("'\"")
    return out


@dataclass(frozen=True)
class Config:
    """A research run's settings; unnamed ones keep their defaults."""

    tickers: tuple[str, ...] = ()
    start: str = "2018-01-01"
    end: str | None = None
    metadata_file: str | None = None
    snapshots_file: str | None = None
    eligibility: dict[str, Any] = field(default_factory=dict)
    llm: dict[str, Any] = field(default_factory=dict)
    output_dir: str | None = None
    benchmark: str = "SPY"
    strategy: dict[str, Any] = field(default_factory=dict)
    risk: dict[str, Any] = field(default_factory=dict)
    backtest: dict[str, Any] = field(default_factory=dict)


def load_config(path: str | Path) -> Config:
    """YAML settings; paths in them are relative to their file. A ticker file wins over the tickers of the snapshots, those over the list."""
    import csv

    import yaml

    path = Path(path)
    raw = yaml.safe_load(path.read_text()) or {}
    at = lambda key: str((path.parent / raw[key]).resolve()) if raw.get(key) else None
    tickers = [t.upper() for t in raw.get("tickers", [])]
    if snapshots := at("snapshots_file"):
        with open(snapshots, newline="") as f:
            tickers = sorted({r["ticker"].strip().upper() for r in csv.DictReader(f)}) or tickers
    if own := at("tickers_file"):
        tickers = [t.upper() for line in Path(own).read_text().splitlines() for t in line.split("#")[0].replace(",", " ").split()]
    if not tickers:
        raise ValueError("the settings name no tickers")
    given = {k: raw[k] for k in ("start", "end", "benchmark", "strategy", "risk", "backtest", "eligibility", "llm") if k in raw}
    paths = {k: at(k) for k in ("metadata_file", "snapshots_file", "output_dir")}
    return Config(tuple(dict.fromkeys(tickers)), **given, **paths)


# --- remote sources, by a client that the caller gives -----------------------


def with_retry(call: Callable[[], Any], attempts: int = 4, wait: float = 1.0, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result, tried again after growing pauses; an error's ``retry_after`` takes the pause's place."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not again(e):
                raise
            sleep(float(getattr(e, "retry_after", None) or wait * 2**k))
    raise ValueError("attempts must be positive")


def download_prices(spark: SparkSession, tickers: Sequence[str], fetch: Callable[[str], Iterable[tuple]], **retry: Any) -> DataFrame:
    """Bars of each ticker from ``fetch(ticker)``: rows (date, open, high, low, close, volume)."""
    # A ticker a task: the bars go from the executor that fetched them to the plan, not through the driver.
    asked = spark.createDataFrame([(t.upper(),) for t in dict.fromkeys(tickers)], "ticker string").repartition(max(1, len(tickers)), "ticker")

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(str(d), t, *map(float, bar)) for t in f["ticker"] for d, *bar in with_retry(lambda t=t: list(fetch(t)), **retry)]
            yield pd.DataFrame(rows, columns=list(PRICE_COLUMNS))

    from quantloom.shared import stage_table

    # Written once: what a plan reads again must not be fetched again.
    got, _ = stage_table(asked.mapInPandas(run, PRICE_SCHEMA), "download")
    if got.isEmpty():
        raise ValueError("no prices were returned")
    return got.withColumn("date", F.to_date("date"))


def page_get(get: Callable[[str], Any], url: str, **retry: Any) -> Any:
    """The answer of ``get(url)``, asked again on the status codes of a busy service, no sooner than it says.

    An answer has status_code and headers; any other error status is an error.
    """

    class Busy(Exception):
        def __init__(self, answer: Any) -> None:
            super().__init__(f"status {answer.status_code} for {url}")
            try:
                self.retry_after = max(float(answer.headers.get("Retry-After")), 0.0)
            except (TypeError, ValueError):
                self.retry_after = None

    def once() -> Any:
        answer = get(url)
        if answer.status_code in BUSY:
            raise Busy(answer)
        if answer.status_code >= 400:
            raise ValueError(f"status {answer.status_code} for {url}")
        return answer

    return with_retry(once, again=lambda e: not isinstance(e, ValueError), **retry)


def list_filings(fetch: Callable[[dict], Mapping[str, Any]], page_size: int = 100, **params: Any) -> list[dict]:
    """All pages of a filing list; a status other than 000 (or 013, nothing found) is an error."""
    out: list[dict] = []
    page = 1
    while True:
        got = fetch({**{k: v for k, v in params.items() if v is not None}, "page_no": page, "page_count": page_size})
        if got.get("status") == "013":
            return out
        if got.get("status") != "000":
            raise ValueError(f"filing list failed: {got.get('status')} {got.get('message', '')}")
        out += got.get("list", [])
        if page >= int(got.get("total_page", 1)):
            return out
        page += 1


# --- charts -------------------------------------------------------------------


def svg_chart(curves: Mapping[str, Sequence[float]], width: int = 900, height: int = 360, margin: int = 40) -> str:
    """A line chart of a few collected curves."""
    values = [v for c in curves.values() for v in c]
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    span = (high - low) or 1.0
    colours = ("#1b6ca8", "#c8553d", "#3a7d44", "#7b4fa3", "#8a6d3b")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    for k, (name, c) in enumerate(curves.items()):
        step = (width - 2 * margin) / max(1, len(c) - 1)
        points = " ".join(f"{margin + i * step:.1f},{height - margin - (v - low) / span * (height - 2 * margin):.1f}" for i, v in enumerate(c))
        out.append(f'<polyline fill="none" stroke="{colours[k % 5]}" points="{points}"/><text x="{margin + 6}" y="{margin + 16 * k}" fill="{colours[k % 5]}">{name}</text>')
    return "".join([*out, "</svg>"])
