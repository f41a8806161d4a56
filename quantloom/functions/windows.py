"""Window expressions with the null rules of the research features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def last_rows(n: int, over: WindowSpec | None = None) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return (over or by_ticker()).rowsBetween(1 - n, 0)


def rolling(fn: Callable[[Column], Column], x: Column, n: int, least: int | None = None, over: WindowSpec | None = None) -> Column:
    """``fn`` over the last n rows, null while fewer than ``least`` (default n) of them are not null."""
    w = last_rows(n, over)
    return F.when(F.count(x).over(w) >= (n if least is None else least), fn(x).over(w))


def change(x: Column, k: int = 1, over: WindowSpec | None = None) -> Column:
    """Relative change against k rows before; null where that is missing or 0."""
    return F.try_divide(x, F.lag(x, k).over(over or by_ticker())) - 1


def zscore(x: Column, groups: WindowSpec) -> Column:
    """Population z-score in the group; 0 for all rows where the deviation is 0 or unknown."""
    sd = F.stddev_pop(x).over(groups)
    return F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise((x - F.avg(x).over(groups)) / sd)


def rank_percentile(x: Column, keys: list[str]) -> Column:
    """Average rank of x over the group's non-null count; 0.5 for all rows of a group with fewer than two values."""
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(x.asc_nulls_last())
    n = F.count(x).over(group)
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(n <= 1, F.lit(0.5)).when(x.isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2.0) / n)


def share_true(flag: Column, groups: WindowSpec) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double")).over(groups)


def forward_fill(x: Column, over: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over((over or by_ticker()).rowsBetween(Window.unboundedPreceding, 0))


def minus_business_days(d: Column, n: int) -> Column:
    """n weekdays (Monday to Friday) before d; a weekend day first moves to the next Monday, as calendars of business days roll."""
    wd = F.weekday(d)
    monday = F.when(wd >= 5, F.date_add(d, 7 - wd)).otherwise(d)
    own = F.when(wd >= 5, F.lit(0)).otherwise(wd)
    weeks, rest = divmod(n, 5)
    return F.date_sub(monday, F.lit(7 * weeks + rest) + F.when(F.lit(rest) > own, 2).otherwise(0))


def month_ends(frame: DataFrame) -> DataFrame:
    """The last date of each month that the frame has."""
    return frame.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date")).select("date")


def keep_last(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("__n", nth).where("__n = 1").drop("__n")


def safe(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rounded_to(x: Column, places: int) -> Column:
    """Half up, by one rule that any engine can repeat exactly; for values below 9e18 / 10**places."""
    return (F.floor(x * F.lit(10.0**places) + 0.5) / F.lit(10.0**places)).cast("double")


def r6(x: Column) -> Column:
    return rounded_to(x, 6)
