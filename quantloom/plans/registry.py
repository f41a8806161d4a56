"""All named queries of the research engine, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.plans import extras, inventory, research, textlane, trading

FLAGSHIP = "momentum_top4"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (research, trading, textlane, extras, inventory):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
