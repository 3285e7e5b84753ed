"""Twelve features of each ticker on each date, and the returns ahead of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ahead, back, log_ratio, roll, trailing
from .factors import _amihud, _volume_shock
from .panel import market_series

# The names of the features, and of the horizons with their trading days.
FEATURES = ["mom_21", "mom_63", "mom_126", "reversal_5", "vol_63", "vol_ratio", "dist_52w_high", "amihud", "volume_shock", "beta_63", "market_mom_63", "market_vol_21"]
HORIZONS = {"1M": 21, "3M": 63, "6M": 126, "12M": 252}


def market_features(panel: DataFrame) -> DataFrame:
    """(date, mkt, market_mom_63, market_vol_21): a row for each date, so one task runs the windows."""
    w = Window.orderBy("d_idx")
    over = lambda agg, n: F.when(F.count("mkt").over(w.rowsBetween(1 - n, 0)) >= n, agg("mkt").over(w.rowsBetween(1 - n, 0)))
    return market_series(panel).select("date", "mkt", over(F.sum, 63).alias("market_mom_63"), over(F.stddev_samp, 21).alias("market_vol_21"))


def add_features(panel: DataFrame) -> DataFrame:
    """panel with the twelve features; rows without any of them are kept. The market's are joined by date (a row for each date of the calendar)."""
    r = F.col("ret")
    rows = panel.join(F.broadcast(market_features(panel)), "date", "left")  # bounded: a trading calendar
    vol = roll(F.stddev_samp, r, 63)
    pair = F.when(r.isNotNull() & F.col("mkt").isNotNull(), F.lit(1))
    w = trailing(63)
    cov = F.when(F.count(pair).over(w) >= 63, F.covar_samp("ret", "mkt").over(w))
    var = F.when(F.count("mkt").over(w) >= 63, F.var_samp("mkt").over(w))
    return rows.select(
        *panel.columns,
        log_ratio(F.col("close"), back("close", 21)).alias("mom_21"), log_ratio(F.col("close"), back("close", 63)).alias("mom_63"),
        log_ratio(back("close", 21), back("close", 126)).alias("mom_126"), (-roll(F.sum, r, 5)).alias("reversal_5"),
        vol.alias("vol_63"), F.try_divide(roll(F.stddev_samp, r, 21), vol).alias("vol_ratio"),
        F.try_divide(F.col("close"), roll(F.max, F.col("close"), 252, 120)).alias("dist_52w_high"),
        _amihud().alias("amihud"), _volume_shock().alias("volume_shock"), F.try_divide(cov, var).alias("beta_63"),
        "market_mom_63", "market_vol_21",
    )


def add_targets(panel: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """panel with fwd_<days>: the log return from a date's close to the close so many dates later."""
    return panel.select("*", *[log_ratio(ahead("close", h), F.col("close")).alias(f"fwd_{h}") for h in (horizons or HORIZONS).values()])


def average_rank(x: str, *by: str):
    """Rank from 1 on among rows that agree in by, ties sharing the mean of their ranks; null for null."""
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(w.orderBy(F.asc_nulls_last(x))) + (ties - 1) / 2)


__all__ = ["FEATURES", "HORIZONS", "add_features", "add_targets", "average_rank", "market_features"]
