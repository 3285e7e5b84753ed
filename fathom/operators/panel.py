"""The dense panel: every ticker on every date of the calendar, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_ticker, back, log_ratio

FILL = 10
TRADED = 1e-12


def unique_prices(prices: DataFrame) -> DataFrame:
    """One row for each ticker and date: the mean of closes, and of volumes."""
    return prices.groupBy("ticker", "date").agg(F.avg("close").alias("close"), F.avg("volume").alias("volume"))


def calendar(prices: DataFrame) -> DataFrame:
    """(date, d_idx): a row for each date, so one task numbers them."""
    return prices.select("date").distinct().withColumn("d_idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def each_day(rows: DataFrame, days: DataFrame) -> DataFrame:
    """rows with each (d_idx, date) of days, which go to each row as one array: for few rows, or for a calendar, which is bounded."""
    listed = days.agg(F.sort_array(F.collect_list(F.struct("d_idx", "date"))).alias("days"))
    return rows.select("*", F.inline(listed.scalar()))


def dense(prices: DataFrame) -> DataFrame:
    """(ticker, date, d_idx, raw_close, volume): each ticker with the whole calendar."""
    grid = each_day(prices.select("ticker").distinct(), calendar(prices))
    return grid.join(prices.withColumnRenamed("close", "raw_close"), ["ticker", "date"], "left").select("ticker", "date", "d_idx", "raw_close", "volume")


def to_panel(prices: DataFrame, unique: bool = False) -> DataFrame:
    """(ticker, date, d_idx, close, volume, ret, traded): closes carried over gaps of at most ten rows, log returns, and whether the price moved. unique: prices has one row for each ticker and date already."""
    rows = dense(prices if unique else unique_prices(prices))
    filled = rows.withColumn("close", F.last("raw_close", ignorenulls=True).over(by_ticker().rowsBetween(-FILL, 0)))
    moved = filled.withColumn("ret", log_ratio(F.col("close"), back("close", 1)))
    return moved.select("ticker", "date", "d_idx", "close", "volume", "ret", F.coalesce(F.abs("ret") > TRADED, F.lit(False)).alias("traded"))


def market_series(panel: DataFrame) -> DataFrame:
    """(date, d_idx, mkt): the mean return of a date, null where no ticker has one."""
    return panel.groupBy("date", "d_idx").agg(F.avg("ret").alias("mkt"))
