"""The research inputs, derived from the shipment tables.

Prices are weekly bars by supplier, the benchmark the same over all suppliers,
sectors the suppliers' regions, and signals the orders' totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.shared import stage_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        F.floor(100 * F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("qty"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


def _sums(ticks: DataFrame, *keys: str) -> DataFrame:
    """What bars are made of, in integers, so that the order of rows cannot change a bar."""
    return ticks.groupBy(*keys, "date").agg(
        F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "cents")).alias("first"),
        F.max("cents").alias("high"),
        F.min("cents").alias("low"),
        F.sum(F.col("cents") * F.col("qty")).alias("notional"),
        F.sum("qty").alias("qty"),
    )


def _bars(sums: DataFrame, *keys: str) -> DataFrame:
    return sums.select(
        "date",
        *keys,
        (F.col("first.cents") / 100.0).alias("open"),
        (F.col("high") / 100.0).alias("high"),
        (F.col("low") / 100.0).alias("low"),
        (F.col("notional").cast("double") / F.col("qty").cast("double") / 100.0).alias("close"),
        F.col("qty").cast("double").alias("volume"),
    )


def _benchmark(sums: DataFrame) -> DataFrame:
    """The bars of all tickers together, from the tickers' sums."""
    whole = sums.groupBy("date").agg(F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("notional").alias("notional"), F.sum("qty").alias("qty"))
    return _bars(whole).withColumn("ticker", F.lit("ALL"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, open, high, low, close, volume): observed weeks only."""
    return _bars(_sums(_ticks(spark, sf_dir), "ticker"), "ticker")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a week over all suppliers."""
    return _benchmark(_sums(_ticks(spark, sf_dir), "ticker"))


@dataclass(frozen=True)
class Bars:
    """The bars of one run, written once: every operator of the run reads them, and none scans the shipments again."""

    prices: DataFrame
    benchmark: DataFrame


def bars(spark: SparkSession, sf_dir: str) -> Bars:
    sums, _ = stage_table(_sums(_ticks(spark, sf_dir), "ticker"), "bars")
    return Bars(_bars(sums, "ticker"), _benchmark(sums))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector, industry)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, horizon_bucket, llm_score, document_count): from order totals, on order dates."""
    orders = table(spark, sf_dir, "orders")
    own = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    bucket = F.when(F.col("o_orderpriority").startswith("1"), "short").when(F.col("o_orderpriority").startswith("2"), "swing").otherwise("long")
    rows = own.select(
        F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        bucket.alias("horizon_bucket"),
        F.floor(100 * F.col("o_totalprice") + 0.5).cast("long").alias("cents"),
        "o_orderkey",
    )
    grouped = rows.groupBy("date", "ticker", "horizon_bucket").agg(F.max("cents").alias("cents"), F.count_distinct("o_orderkey").alias("document_count"))
    return grouped.select("date", "ticker", "horizon_bucket", ((F.col("cents") % 2001 - 1000) / 1000.0).alias("llm_score"), "document_count")


#: The same in DuckDB's SQL, as common table expressions in order of use.
SQL = {
    "ticks": """SELECT 'S' || l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
        CAST(floor(100 * l_extendedprice / l_quantity + 0.5) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty,
        l_orderkey, l_linenumber, l_partkey FROM lineitem""",
    "prices": """SELECT date, ticker, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, cents := cents)).cents / 100e0 AS open,
        max(cents) / 100e0 AS high, min(cents) / 100e0 AS low,
        CAST(sum(cents * qty) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) / 100e0 AS close, CAST(sum(qty) AS DOUBLE) AS volume
        FROM ticks GROUP BY date, ticker""",
    "benchmark_bars": """SELECT date, CAST(sum(cents * qty) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) / 100e0 AS close,
        CAST(sum(qty) AS DOUBLE) AS volume FROM ticks GROUP BY date""",
    "metadata": """SELECT 'S' || s_suppkey AS ticker, r_name AS sector, n_name AS industry FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "signals": """SELECT date, ticker, horizon_bucket, (max(cents) % 2001 - 1000) / 1000e0 AS llm_score, count(DISTINCT o_orderkey) AS document_count
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, 'S' || l_suppkey AS ticker,
            CASE WHEN o_orderpriority LIKE '1%' THEN 'short' WHEN o_orderpriority LIKE '2%' THEN 'swing' ELSE 'long' END AS horizon_bucket,
            CAST(floor(100 * o_totalprice + 0.5) AS BIGINT) AS cents, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        GROUP BY date, ticker, horizon_bucket""",
}
