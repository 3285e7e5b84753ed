"""Trailing windows over a ticker's rows of the trading calendar.

All share one partitioning (ticker) and order (d_idx), so Spark plans one exchange and one sort for any number of them.
A ticker's history is bounded by the calendar; no window spans tickers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("d_idx")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def trailing(n: int):
    return by_ticker().rowsBetween(1 - n, 0)


def roll(agg: Callable[[Column], Column], x: Column, n: int, least: int | None = None) -> Column:
    """agg of x over the last n rows, null unless least (default n) of them have a value."""
    return F.when(F.count(x).over(trailing(n)) >= (n if least is None else least), agg(x).over(trailing(n)))


def back(name: str, n: int) -> Column:
    return F.lag(name, n).over(by_ticker())


def ahead(name: str, n: int) -> Column:
    return F.lead(name, n).over(by_ticker())


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null where b is zero or the ratio isn't positive."""
    return F.ln(F.try_divide(a, b))


def median(x: Column) -> Column:
    return F.percentile(x, 0.5)
