"""The factor library: ten scores of each ticker on each date, in one projection over one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import by_date, back, log_ratio, roll

#: Those that the composite averages.
COMPOSED = ["momentum_126_21", "reversal_5d", "low_volatility", "high_52w", "trend_ma_20_100"]


def _amihud(c: str = "close", v: str = "volume") -> Column:
    return F.log1p(1e6 * roll(F.avg, F.try_divide(F.abs("ret"), F.nullif(F.col(v) * F.col(c), F.lit(0.0))), 63, 20))


def _volume_shock() -> Column:
    v = F.nullif(F.col("volume"), F.lit(0.0))
    return log_ratio(roll(F.avg, v, 5), roll(F.avg, v, 63, 20))


#: Name to a function that gives the score's column over a panel. Add to it to extend the library.
FACTORS = {
    "momentum_126_21": lambda: log_ratio(back("close", 21), back("close", 126)),
    "momentum_63_10": lambda: log_ratio(back("close", 10), back("close", 63)),
    "reversal_5d": lambda: -roll(F.sum, F.col("ret"), 5),
    "reversal_21d": lambda: -roll(F.sum, F.col("ret"), 21),
    "low_volatility": lambda: -roll(F.stddev_samp, F.col("ret"), 63),
    "high_52w": lambda: F.try_divide(F.col("close"), roll(F.max, F.col("close"), 252, 60)),
    "amihud_illiquidity": _amihud,
    "abnormal_volume": _volume_shock,
    "trend_ma_20_100": lambda: F.try_divide(roll(F.avg, F.col("close"), 20), roll(F.avg, F.col("close"), 100, 60)) - 1,
}
NAMES = [*FACTORS, "composite"]


def zscore(name: str) -> Column:
    """Of a date's tickers; null where they don't differ."""
    sd = F.stddev_samp(name).over(by_date())
    return (F.col(name) - F.avg(name).over(by_date())) / F.nullif(sd, F.lit(0.0))


def add_factors(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """panel with a column for each factor named (default: all ten)."""
    names = list(names or NAMES)
    own = [n for n in FACTORS if n in names or ("composite" in names and n in COMPOSED)]
    out = panel.select("*", *[FACTORS[n]().alias(n) for n in own])
    if "composite" in names:
        z = F.array_compact(F.array(*[zscore(n) for n in COMPOSED]))
        mean = F.when(F.size("__z") > 0, F.aggregate("__z", F.lit(0.0), lambda a, x: a + x) / F.size("__z"))
        out = out.withColumn("__z", z).withColumn("composite", mean).drop("__z")
    return out.select(*panel.columns, *names)


def long_scores(factors: DataFrame, names: list[str]) -> DataFrame:
    """(strategy, ticker, date, d_idx, score)."""
    return factors.unpivot(["ticker", "date", "d_idx"], names, "strategy", "score")
