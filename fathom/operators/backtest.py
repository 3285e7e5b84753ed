"""Eligibility, weights of long-only strategies, costs and performance; all strategies in one plan, by strategy."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import median, roll, trailing
from ..sources.store import written
from .factors import add_factors
from .panel import each_day

MIN_TRADED = 0.60
MIN_TURNOVER = 50_000.0
YEAR = 252
BASELINE = "baseline_equal_weight"


def traded_share(n: int = 63, least: int = 20) -> Column:
    return F.when(F.count(F.lit(1)).over(trailing(n)) >= least, F.avg(F.col("traded").cast("double")).over(trailing(n)))


def money_volume(n: int = 63, least: int = 20) -> Column:
    return roll(median, F.col("volume") * F.col("close"), n, least)


def eligibility(panel: DataFrame) -> DataFrame:
    """panel with traded_share, money_volume and eligible. Volume counts only if some row of the panel has one."""
    seen = panel.agg(F.count("volume").alias("n")).scalar()
    out = panel.select("*", traded_share().alias("traded_share"), money_volume().alias("money_volume"))
    liquid = (seen == 0) | F.coalesce(F.col("money_volume") >= MIN_TURNOVER, F.lit(False))
    return out.withColumn("eligible", F.coalesce(F.col("traded_share") >= MIN_TRADED, F.lit(False)) & liquid)


def targets(scores: DataFrame, every: int = 5, quantile: Column | float = 0.20) -> DataFrame:
    """(strategy, d_idx, ticker, weight) at rebalances: equal weights on the best of at least five scored, eligible tickers.

    scores: (strategy, ticker, d_idx, score, eligible). Ties go to the ticker that comes first.
    """
    q = F.lit(quantile) if isinstance(quantile, float) else quantile
    at = scores.where((F.col("d_idx") % every == 0) & F.col("eligible") & F.col("score").isNotNull())
    w = Window.partitionBy("strategy", "d_idx")
    ranked = at.select("strategy", "d_idx", "ticker", F.row_number().over(w.orderBy(F.desc("score"), "ticker")).alias("rank"), F.count(F.lit(1)).over(w).alias("n"), q.alias("q"))
    top = F.greatest(F.lit(3), F.ceil(F.col("n") * F.col("q")))
    return ranked.where((F.col("n") >= 5) & (F.col("rank") <= top)).select("strategy", "d_idx", "ticker", (1.0 / top).alias("weight"))


def held(goals: DataFrame, days: DataFrame) -> DataFrame:
    """(strategy, d_idx, ticker, weight): the weights of each date, those of the last rebalance that there was."""
    reb = goals.select("strategy", "d_idx").distinct()
    every = each_day(reb.select("strategy").distinct(), days).drop("date")
    w = Window.partitionBy("strategy").orderBy("d_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = every.join(reb.withColumn("at", F.col("d_idx")), ["strategy", "d_idx"], "left").withColumn("at", F.max("at").over(w)).where("at is not null")
    return last.join(goals.withColumnRenamed("d_idx", "at"), ["strategy", "at"]).select("strategy", "d_idx", "ticker", "weight")


def daily(weights: DataFrame, panel: DataFrame, cost_bps: float = 100.0) -> DataFrame:
    """(strategy, d_idx, gross, turnover, net) of dates with a position or a trade: yesterday's weights earn today's returns; trades cost."""
    # each weight counts twice: a date later as what is held, two dates later as what was held before
    steps = F.explode(F.array(*[F.struct((F.col("d_idx") + n).alias("d_idx"), F.when(F.lit(n) == 1, F.col("weight")).otherwise(0.0).alias("w"), F.when(F.lit(n) == 2, F.col("weight")).otherwise(0.0).alias("w0")) for n in (1, 2)]))
    both = weights.select("strategy", "ticker", steps.alias("s")).groupBy("strategy", "ticker", "s.d_idx").agg(F.sum("s.w").alias("w"), F.sum("s.w0").alias("w0"))
    rets = panel.select("ticker", "d_idx", "date", "ret")  # dates after the last are no dates
    joined = both.join(rets, ["ticker", "d_idx"])
    return (
        joined.groupBy("strategy", "date", "d_idx")
        .agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum(F.abs(F.col("w") - F.col("w0"))).alias("turnover"))
        .withColumn("net", F.col("gross") - F.col("turnover") * (cost_bps / 10_000.0))
    )


def strategies(panel: DataFrame, names: list[str], every: int = 5, quantile: float = 0.20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the strategies (factors, and the baseline if it is named), the goals at rebalances, and the calendar. Factors, eligibility and scores are columns of one pass over the panel, which then becomes long. Goals are few and used three times, so they are written."""
    own = [n for n in names if n != BASELINE]
    rows = eligibility(panel)
    wide = add_factors(rows, own) if own else rows
    if BASELINE in names:
        wide = wide.withColumn(BASELINE, F.lit(1.0))
    scores = wide.unpivot(["ticker", "d_idx", "eligible"], names, "strategy", "score").select("strategy", "ticker", "d_idx", "score", "eligible")
    share = F.when(F.col("strategy") == BASELINE, 1.0).otherwise(quantile)
    goals = written(panel.sparkSession, targets(scores, every, share), "goals")
    return scores, goals, panel.select("date", "d_idx").distinct()


def net_returns(panel: DataFrame, names: list[str], every: int = 5, quantile: float = 0.20, cost_bps: float = 100.0, warmup: int = 130) -> DataFrame:
    """(strategy, date, d_idx, gross, turnover, net) of factors, and the baseline if it is named, from the warm-up on."""
    _, goals, days = strategies(panel, names, every, quantile)
    listed = panel.sparkSession.createDataFrame([(n,) for n in names], "strategy string")
    return on_calendar(days, listed, daily(held(goals, days), panel, cost_bps), warmup)


def active(net: DataFrame) -> DataFrame:
    """(strategy, d_idx, x): what each strategy earns over the baseline."""
    flat = net.where(F.col("strategy") == BASELINE).select("d_idx", F.col("net").alias("n0"))
    return net.where(F.col("strategy") != BASELINE).join(flat, "d_idx").select("strategy", "d_idx", (F.col("net") - F.col("n0")).alias("x"))


def on_calendar(days: DataFrame, strategies: DataFrame, net: DataFrame, warmup: int) -> DataFrame:
    """net with a row for every strategy and date from warmup on; nothing held earns nothing."""
    grid = each_day(strategies, days.where(F.col("d_idx") >= warmup))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gross", "turnover", "net")]
    return grid.join(net.drop("date"), ["strategy", "d_idx"], "left").select("strategy", "date", "d_idx", *zero)


def performance(net: DataFrame) -> DataFrame:
    """By strategy: return and volatility of a year, Sharpe ratio, largest drawdown of summed log returns, share of days up, days, mean turnover. Null below 40 days."""
    w = Window.partitionBy("strategy").orderBy("d_idx").rowsBetween(Window.unboundedPreceding, 0)
    curve = net.withColumn("equity", F.sum("net").over(w)).withColumn("drawdown", F.col("equity") - F.max("equity").over(w))
    agg = curve.groupBy("strategy").agg(
        (F.avg("net") * YEAR).alias("ann_return"), (F.stddev_samp("net") * sqrt(YEAR)).alias("ann_vol"), F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.count("net").alias("days"), F.avg("turnover").alias("avg_daily_turnover"),
    )
    enough = F.col("days") >= 40
    sharpe = F.when(F.col("ann_vol") > 0, F.col("ann_return") / F.nullif(F.col("ann_vol"), F.lit(0.0))).otherwise(0.0)
    keep = {c: F.when(enough, F.col(c)) for c in ("ann_return", "ann_vol", "max_drawdown", "hit_rate")}
    return agg.withColumn("sharpe", F.when(enough, sharpe)).withColumns(keep)
