"""The data behind a dashboard's tables."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import back, by_ticker, log_ratio, roll

#: Order of horizons for display.
ORDER = {"1M": 1, "3M": 2, "6M": 3, "12M": 4}


def performance(panel: DataFrame) -> DataFrame:
    """Of each ticker's closes that exist: the last, its change over 21, 63 and 252 of them in percent, and the year's volatility."""
    rows = panel.where("close is not null")
    change = lambda n: 100 * (F.try_divide(F.col("close"), F.lag("close", n).over(by_ticker())) - 1)
    last = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d_idx")))
    vol = 100 * sqrt(252) * F.stddev_samp("own").over(Window.partitionBy("ticker"))
    own = rows.withColumn("own", log_ratio(F.col("close"), back("close", 1)))
    out = own.select("ticker", F.col("close").alias("last_price"), change(21).alias("ret_1m_pct"), change(63).alias("ret_3m_pct"), change(252).alias("ret_1y_pct"), vol.alias("ann_vol_pct"), last.alias("k"))
    return out.where("k = 1").drop("k")


def moving_average(panel: DataFrame, n: int = 50) -> DataFrame:
    """(ticker, date, close, volume, ma50) of dates with a close; the mean is of such dates."""
    return panel.where("close is not null").select("ticker", "date", "close", "volume", roll(F.avg, F.col("close"), n).alias("ma50"))


def _by_horizon() -> Column:
    return F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])[F.col("horizon")]


def forecasts_of(forecasts: DataFrame, ticker: str) -> DataFrame:
    """One ticker's forecasts, the nearest horizon first."""
    return forecasts.where(F.col("ticker") == ticker).orderBy(_by_horizon())


def forecasts_in_order(forecasts: DataFrame) -> DataFrame:
    """(ticker, horizon, place, expected_return_pct, low_5pct, high_95pct): forecasts_of() of all tickers at once, place 1 for the nearest horizon."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(_by_horizon())).cast("long")
    return forecasts.select("ticker", "horizon", place.alias("place"), "expected_return_pct", "low_5pct", "high_95pct")


def leaderboard(perf: DataFrame) -> DataFrame:
    """Strategies by falling Sharpe ratio, rounded for display."""
    return perf.orderBy(F.desc_nulls_last("sharpe"), "strategy").select("strategy", F.round("sharpe", 3).alias("sharpe"), F.round(100 * F.col("ann_return"), 2).alias("ann_return_pct"), F.round(100 * F.col("max_drawdown"), 2).alias("max_drawdown_pct"), F.round("avg_daily_turnover", 4).alias("avg_daily_turnover"))


def audit_by_ratio(stocks: DataFrame) -> DataFrame:
    return stocks.orderBy(F.desc_nulls_last("variance_ratio_q5"), "ticker").select("ticker", "variance_ratio_q5", "traded_share")


# Labels of the columns of two tables.
TOP_TEN = {"ticker": "Valeur", "expected_return_pct": "Prevision 3M %", "low_5pct": "Pire cas 5%", "high_95pct": "Meilleur cas 95%", "pourquoi": "Pourquoi"}
HORIZON_SKILL = "horizon string, `echantillons_OOS` long, IC double, t_stat double, `confiance_%` long"


def top_ten(forecasts: DataFrame) -> DataFrame:
    """The best forecasts with reasons, under the labels of the dashboard."""
    return forecasts.select(*[F.col(c).alias(label) for c, label in TOP_TEN.items()])


def horizon_skill(spark: SparkSession, report: dict) -> DataFrame:
    """A row for each horizon of the forecasts' report, in its order: samples out of sample, skill, and trust in the model in percent."""
    rows = []
    for horizon, r in report.get("horizons", {}).items():
        skill = r.get("skill") or {}
        rows.append((horizon, int(r.get("oos_samples") or 0), round(float(skill.get("ic") or 0), 3), round(float(skill.get("t_stat") or 0), 2), round(100 * float(r.get("forecast_shrinkage") or 0))))
    return spark.createDataFrame(rows, HORIZON_SKILL)


def gates_passed(gates: dict[str, bool]) -> int:
    return sum(map(bool, gates.values()))
