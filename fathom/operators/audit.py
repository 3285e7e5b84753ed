"""Is the market efficient? Variance ratios, autocorrelation and the momentum spread."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ahead, back, log_ratio
from ..functions.stats import chi2_sf

LEAST = 100


def _compact(panel: DataFrame) -> DataFrame:
    """(ticker, i, r, d, n): returns that exist, one after another, and their distance from the mean."""
    w = Window.partitionBy("ticker")
    some = panel.where("ret is not null")
    return some.select("ticker", F.row_number().over(w.orderBy("d_idx")).alias("i"), F.col("ret").alias("r"), (F.col("ret") - F.avg("ret").over(w)).alias("d"), F.count(F.lit(1)).over(w).alias("n"))


def _lag(c: str, k: int):
    return F.lag(c, k).over(Window.partitionBy("ticker").orderBy("i"))


def variance_ratio(panel: DataFrame, q: int = 5, corrected: bool = False) -> DataFrame:
    """(ticker, vr, z): null below 100 returns. corrected: z with the root of the number of returns, which makes it a standard normal under a random walk."""
    rows = _compact(panel).where(F.col("n") >= LEAST)
    w = Window.partitionBy("ticker").orderBy("i").rowsBetween(1 - q, 0)
    lags = {f"p{k}": F.col("d") ** 2 * _lag("d", k) ** 2 for k in range(1, q)}
    wide = rows.select("*", F.when(F.col("i") >= q, F.sum("d").over(w)).alias("dq"), *[e.alias(c) for c, e in lags.items()])
    s = wide.groupBy("ticker").agg(F.first("n").alias("n"), F.sum(F.col("d") ** 2).alias("ss"), F.sum(F.col("dq") ** 2).alias("ssq"), *[F.sum(c).alias(c) for c in lags])
    ss = F.nullif(F.col("ss"), F.lit(0.0))
    theta = sum(((2 * (q - k) / q) ** 2 * F.col(f"p{k}") / (ss * ss / F.col("n")) for k in range(1, q)), F.lit(0.0))
    vr = F.col("ssq") / (F.col("n") * q) / (ss / F.col("n"))
    z = (vr - 1) / F.sqrt(F.nullif(theta, F.lit(0.0)))
    return s.select("ticker", vr.alias("vr"), (z * F.sqrt("n") if corrected else z).alias("z"))


def ljung_box(panel: DataFrame, lags: int = 10) -> DataFrame:
    """(ticker, stat, p_value) of so many autocorrelations; only tickers with 100 returns or more."""
    rows = _compact(panel).where(F.col("n") >= LEAST)
    wide = rows.select("ticker", "n", "d", *[(F.col("d") * _lag("d", k)).alias(f"c{k}") for k in range(1, lags + 1)])
    s = wide.groupBy("ticker").agg(F.first("n").alias("n"), F.sum(F.col("d") ** 2).alias("ss"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    ss = F.nullif(F.col("ss"), F.lit(0.0))
    rho2 = sum((((F.col(f"c{k}") / ss) ** 2) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    stat = F.col("n") * (F.col("n") + 2) * rho2
    return s.select("ticker", stat.alias("stat"), chi2_sf(stat, lags).alias("p_value"))


def momentum_spreads(panel: DataFrame, lookback: int = 126, skip: int = 21, horizon: int = 21) -> DataFrame:
    """(d_idx, spread): on every horizon-th date with ten signals or more, what past winners earn next over past losers."""
    days = panel.agg(F.max("d_idx") + 1).scalar()
    rows = panel.select("ticker", "d_idx", log_ratio(back("close", skip), back("close", lookback)).alias("signal"), log_ratio(ahead("close", horizon), F.col("close")).alias("future"))
    at = rows.where((F.col("d_idx") >= lookback) & (F.col("d_idx") < days - horizon) & ((F.col("d_idx") - lookback) % horizon == 0) & F.col("signal").isNotNull())
    w = Window.partitionBy("d_idx")
    ranked = at.select("*", F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("signal"), "ticker")).alias("up"), F.row_number().over(w.orderBy("signal", "ticker")).alias("down"))
    k = F.greatest(F.lit(3), F.floor(F.col("n") / 5))
    mean = lambda rank: F.avg(F.when(F.col(rank) <= k, F.col("future")))
    return ranked.where("n >= 10").groupBy("d_idx").agg((mean("up") - mean("down")).alias("spread")).where("spread is not null")


def momentum_check(spreads: DataFrame) -> DataFrame:
    """(periods, mean_monthly_spread_pct, t_stat, positive_share) in one row; only periods below five."""
    s = spreads.agg(F.count("spread").alias("periods"), F.avg("spread").alias("m"), F.stddev_samp("spread").alias("sd"), F.avg((F.col("spread") > 0).cast("double")).alias("share"))
    enough = F.col("periods") >= 5
    t = F.when(F.col("sd") > 0, F.col("m") / F.nullif(F.col("sd") / F.sqrt("periods"), F.lit(0.0))).otherwise(0.0)
    return s.select("periods", F.when(enough, F.col("m") * 100).alias("mean_monthly_spread_pct"), F.when(enough, t).alias("t_stat"), F.when(enough, F.col("share")).alias("positive_share"))


def stock_audit(panel: DataFrame) -> DataFrame:
    """(ticker, days, ann_vol, traded_share, variance_ratio_q5, z, ljung_box_p) of every ticker; the p-value of z is two-sided normal."""
    base = panel.groupBy("ticker").agg(F.count("ret").alias("days"), (F.stddev_pop("ret") * sqrt(252)).alias("ann_vol"), F.avg(F.col("traded").cast("double")).alias("traded_share"))
    vr, lb = variance_ratio(panel).withColumnRenamed("vr", "variance_ratio_q5"), ljung_box(panel).select("ticker", F.col("p_value").alias("ljung_box_p"))
    return base.join(vr, "ticker", "left").join(lb, "ticker", "left")


def market_summary(panel: DataFrame) -> DataFrame:
    """One row over all tickers."""
    s, days = stock_audit(panel), panel.agg(F.countDistinct("date").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    z95 = 1.959963984540054
    got = s.agg(
        F.count(F.lit(1)).alias("tickers"), F.median("traded_share").alias("median_traded_share"), F.count_if(F.col("traded_share") < 0.6).alias("illiquid_stocks_below_60pct"),
        F.median("variance_ratio_q5").alias("median_vr_q5"), F.count_if(F.abs("z") > z95).alias("stocks_rejecting_random_walk_5pct"),
        F.avg((F.col("variance_ratio_q5") > 1).cast("double")).alias("share_vr_above_1"), F.count_if(F.col("ljung_box_p") < 0.05).alias("autocorrelation_ljung_box_significant"),
    )
    return got.select("*", days.select("n").scalar().alias("trading_days"), days.select("a").scalar().alias("first_date"), days.select("b").scalar().alias("last_date"))
