"""Is a backtest luck? Bootstraps, the reality check of a family, and the deflated Sharpe ratio.

Draws are tables made by a formula from (replicate, position), so a task that runs again draws the same, and every
factor of a family is drawn at the same dates. Single draws are joined with the returns and averaged; a block of days is
one difference of running sums. A factor's daily returns are a row for each date of the calendar.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import luck, normal_cdf, sharpe_sd
from ..sources.store import written
from .backtest import YEAR

BLOCK = 10


def draw(rep: Column, i: Column, n: Column, seed: int = 7) -> Column:
    """A position from 0 to n - 1 for a replicate and a place in it."""
    x = (rep * 7919 + i * 104729 + F.lit(seed) * 611953) % 2147483647
    return (((x * 48271) % 2147483647) * 69621) % 2147483647 % n


def numbered(active: DataFrame) -> DataFrame:
    """active (strategy, d_idx, x) with position k and length n of its strategy; rows without x are left out."""
    w = Window.partitionBy("strategy")
    some = active.where("x is not null")
    return some.select("strategy", "x", (F.row_number().over(w.orderBy("d_idx")) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(w).alias("n"))


def by_place(rows: DataFrame, names: list[str] | None, *keys: str) -> tuple[DataFrame, list[str]]:
    """rows (strategy, x, *keys) with a row for each place and a column x0, x1, ... for each strategy (names: those that there are), and the strategies in that order."""
    if names is None:
        names = sorted(r.strategy for r in rows.select("strategy").distinct().collect())  # a row for each factor
    each = [F.max(F.when(F.col("strategy") == n, F.col("x"))).alias(f"x{i}") for i, n in enumerate(names)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *each).drop("size"), names


def _long(means: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """(strategy, *keys, m) of columns x0, x1, ..."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"x{i}").alias("m")) for i, n in enumerate(names)]))
    return means.select(*keys, each.alias("e")).select("e.strategy", *keys, "e.m").where("m is not null")


def bootstrap_means(active: DataFrame, replicates: int = 2000, seed: int = 7, names: list[str] | None = None) -> DataFrame:
    """(strategy, rep, mean): yearly means of as many daily draws, with replacement, as there are days. Strategies of equal length share their draws, so a draw meets the returns of all at once."""
    wide, names = by_place(numbered(active), names, "n", "k")
    if not names:
        return active.select("strategy", F.lit(0).alias("rep"), F.lit(0.0).alias("mean")).limit(0)
    places = wide.select("n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"), F.col("k").alias("i"))
    picks = places.select("n", "rep", draw(F.col("rep").cast("long"), F.col("i"), F.col("n"), seed).alias("k"))
    means = picks.join(F.broadcast(wide), ["n", "k"]).groupBy("n", "rep").agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(names))])  # bounded: a trading calendar
    return _long(means, names, "n", "rep").select("strategy", "rep", (F.col("m") * YEAR).alias("mean"))


def bootstrap(active: DataFrame, replicates: int = 2000, seed: int = 7, names: list[str] | None = None) -> DataFrame:
    """(strategy, mean_ann, ci05, ci95, p_le_0); 0, 0, 0 and 1 below 40 days or without any variation."""
    base = active.groupBy("strategy").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
    means = bootstrap_means(active, replicates, seed, names).groupBy("strategy").agg(F.percentile("mean", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.avg((F.col("mean") <= 0).cast("double")).alias("p"))
    good = (F.col("n") >= 40) & (F.col("sd") > 0)
    out = base.join(means, "strategy", "left")
    value = lambda c, other: F.when(good, c).otherwise(F.lit(other))
    return out.select("strategy", value(F.col("m") * YEAR, 0.0).alias("mean_ann"), value(F.col("q")[0], 0.0).alias("ci05"), value(F.col("q")[1], 0.0).alias("ci95"), value(F.col("p"), 1.0).alias("p_le_0"))


def filled(active: DataFrame) -> DataFrame:
    """Dates on which any factor has a value, others zero, at positions shared by all factors."""
    days = active.where("x is not null").select("d_idx").distinct()
    w = Window.orderBy("d_idx")  # a row for each date
    at = days.withColumn("k", (F.row_number().over(w) - 1).cast("long"))
    return active.join(at, "d_idx").select("strategy", "k", F.coalesce("x", F.lit(0.0)).alias("x"))


def block_sums(wide: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """(k, part, s0, s1, ...): sums of x0, x1, ... over the block that begins at place k and runs on at the first place after the last.

    part 0: of a whole block; 1: of as much of it as the last block of a replicate has. Differences of running sums over
    the places and the first block again, so a block costs one look-up, whatever its length.
    """
    columns = [f"x{i}" for i in range(len(names))]
    n = wide.agg(F.count(F.lit(1)))
    again = wide.where(F.col("k") < block).withColumn("k", F.col("k") + n.scalar())
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each date
    ahead = wide.unionByName(again).select("k", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in columns])
    rest = (n.scalar() - 1) % block + 1
    lengths = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(block).cast("long").alias("length")), F.struct(F.lit(1).alias("part"), rest.cast("long").alias("length")))).alias("p")
    start = ahead.where(F.col("k") < n.scalar()).select("k", lengths, *columns).select("k", "p.part", (F.col("k") + F.col("p.length")).alias("end"), *[F.col(c).alias(f"from_{c}") for c in columns])
    end = ahead.select(F.col("k").alias("end"), *columns)
    return start.join(end, "end").select("k", "part", *[(F.col(c) - F.col(f"from_{c}")).alias(f"s{i}") for i, c in enumerate(columns)])


def family_maxima(rows: DataFrame, replicates: int, seed: int = 106, block: int = BLOCK, names: list[str] | None = None) -> DataFrame:
    """(rep, stat): the largest recentred mean over factors of each replicate, times the root of the number of places. rows: as filled() gives them. Replicates are circular blocks of places, of which each is one row of block_sums()."""
    wide, names = by_place(rows, names, "k")
    if not names:
        return rows.select(F.lit(0).cast("long").alias("rep"), F.lit(0.0).alias("stat")).limit(0)
    wide = written(rows.sparkSession, wide.na.fill(0.0), "places")  # a row for each date
    size = wide.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(names))])
    reps = rows.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    blocks = F.ceil(F.col("n") / block)
    places = reps.join(F.broadcast(size.where("n > 0"))).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("b"))  # bounded: one row
    picks = places.select("rep", "n", draw(F.col("rep"), F.col("b") + blocks, F.col("n"), seed).alias("k"), (F.col("b") == blocks - 1).cast("int").alias("part"))
    sums = picks.join(F.broadcast(block_sums(wide, names, block)), ["k", "part"])  # bounded: a trading calendar
    drawn = sums.groupBy("rep", "n").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))]).join(F.broadcast(size.drop("n")))  # bounded: one row
    best = F.array_max(F.array(*[F.col(f"s{i}") / F.col("n") - F.col(f"m{i}") for i in range(len(names))]))
    return drawn.select("rep", (best * F.sqrt("n")).alias("stat"))


def reality_check(active: DataFrame, replicates: int = 1000, seed: int = 106, block: int = BLOCK, names: list[str] | None = None) -> DataFrame:
    """(statistic, p_value, best_factor, factors_in_family) in one row, none below 60 days: White's reality check, how often the best of the family, recentred, does as well by circular blocks of days."""
    rows = filled(active)
    every = Window.partitionBy()  # a row for each factor
    means = rows.groupBy("strategy").agg(F.avg("x").alias("m"), (F.max("k") + 1).alias("n"))
    ranked = means.select("strategy", "m", F.row_number().over(every.orderBy(F.desc("m"), "strategy")).alias("place"), F.max("n").over(every).alias("n"), F.count(F.lit(1)).over(every).alias("factors_in_family"))
    best = ranked.where("place = 1 and n >= 60").select((F.sqrt("n") * F.col("m")).alias("statistic"), F.col("strategy").alias("best_factor"), "factors_in_family")
    each = family_maxima(rows, replicates, seed, block, names).join(F.broadcast(best), how="inner")  # bounded: one row
    p = (F.count_if(F.col("stat") >= F.col("statistic")) + 1) / (F.count(F.lit(1)) + 1)
    return each.groupBy("statistic", "best_factor", "factors_in_family").agg(p.alias("p_value")).select("statistic", "p_value", "best_factor", "factors_in_family")


def moments(net: DataFrame) -> DataFrame:
    """(strategy, n, sr, skew, kurtosis): what the deflated Sharpe ratio needs; kurtosis of a normal is 3."""
    sd = F.stddev_samp("net")
    return net.groupBy("strategy").agg(
        F.count("net").alias("n"), (F.avg("net") / F.nullif(sd, F.lit(0.0))).alias("sr"), F.when(sd > 0, F.skewness("net")).alias("skew"), F.when(sd > 0, F.kurtosis("net") + 3).alias("kurtosis")
    )


def deflated_sharpe(net: DataFrame, trials: int) -> DataFrame:
    """(strategy, daily_sharpe, annualized_sharpe, threshold_from_n_trials, n_trials, dsr): is a strategy's Sharpe ratio more than the best of so many trials by luck? dsr 0, the rest null, below 60 days or without variation."""
    m = moments(net).withColumn("sd", sharpe_sd(F.col("sr"), F.col("skew"), F.col("kurtosis"), F.col("n"))).withColumn("bar", F.col("sd") * luck(trials))
    good = (F.col("n") >= 60) & F.col("sr").isNotNull()
    dsr = normal_cdf((F.col("sr") - F.col("bar")) / F.col("sd")) if trials > 1 else F.lit(1.0)
    of = lambda c: F.when(good, c)
    return m.select(
        "strategy", of(F.col("sr")).alias("daily_sharpe"), of(F.col("sr") * sqrt(YEAR)).alias("annualized_sharpe"), of(F.col("bar") * sqrt(YEAR)).alias("threshold_from_n_trials"),
        of(F.lit(trials)).alias("n_trials"), F.coalesce(of(dsr), F.lit(0.0)).alias("dsr"),
    )


def ranking(perf: DataFrame) -> DataFrame:
    """perf (strategy, sharpe, ...) with place, 1 for the highest Sharpe ratio; unknown ones count as -9; ties by name."""
    w = Window.orderBy(F.desc(F.coalesce("sharpe", F.lit(-9.0))), "strategy")  # a row for each factor
    return perf.withColumn("place", F.row_number().over(w))


# The names of the gates.
GATES = ["sharpe_positive", "beats_baseline_ci", "reality_check_significant", "deflated_sharpe_solid"]


def gates(perf: DataFrame, boot: DataFrame, check: DataFrame, deflated: DataFrame) -> DataFrame:
    """(strategy, gate, passed): whether the best factor may be deployed. It must earn, more than the baseline, more than luck in its family, and more than luck among so many trials. What isn't known isn't passed."""
    best = ranking(perf).where("place = 1").select("strategy", "sharpe")
    all_ = best.join(boot.select("strategy", "ci05"), "strategy", "left").join(deflated.select("strategy", "dsr"), "strategy", "left")
    p = check.agg(F.min("p_value")).scalar()
    passed = [F.col("sharpe") > 0, F.col("ci05") > 0, p < 0.05, F.col("dsr") > 0.90]
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for g, c in zip(GATES, passed, strict=True)]))
    return all_.select("strategy", each.alias("g")).select("strategy", "g.gate", "g.passed")
