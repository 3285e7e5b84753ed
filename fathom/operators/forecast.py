"""Forecasts: purged walk-forward of a ridge and boosted trees, their skill, and forecasts shrunk by it.

The ridge needs only sums over the rows before a refit: Spark sums them between one refit and the next, adds those up, and
a refit is solved from a hundred numbers by expressions over its row. The trees of a refit are grown in a group of its rows up to the refit, which
is bounded by tickers times calendar; all refits of all horizons are grown in parallel.
"""

from __future__ import annotations

import functools
from math import pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..sources.store import written
from .features import FEATURES, average_rank

REFIT = 42
MIN_DAYS = 150
MIN_ROWS = 200
#: What is added to the variance of a normal, and the fewest rows it stands for.
LEAST_SPREAD = 1e-6
LEAST_SHARE = 1e-9


# ---------------------------------------------------------------- models, in numpy


class Boosting:
    """Gradient boosting of squared error with trees of depth 3 over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.05, depth: int = 3, l2: float = 1.0, bins: int = 64, least: int = 20):
        self.rate, self.base, self.trees = rate, float(y.mean()), []
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        keys, at = b + np.arange(x.shape[1]) * bins, np.full(len(y), self.base)
        for _ in range(rounds):
            *tree, node = self._grow(b, keys, y - at, depth, l2, bins, least)
            self.trees.append(tree)
            at += rate * tree[2][node]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    @staticmethod
    def _grow(b, keys, g, depth, l2, bins, least):
        """(feature, cut, leaf, depth, node): the tree, and each row's leaf. A level's sums of all nodes, features and bins are one count over the rows."""
        p = b.shape[1]
        node, feature, cut, weights = np.zeros(len(g), int), {}, {}, np.repeat(g, p)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = np.where(node >= first, node - first, n)  # n: rows whose node wasn't split
            at = (keys + (local * p * bins)[:, None]).ravel()
            s, c = (np.bincount(at, w, (n + 1) * p * bins)[: n * p * bins].reshape(n, p, bins).cumsum(axis=2) for w in (weights, None))
            st, ct = s[:, :, -1:], c[:, :, -1:]
            gain = s**2 / (c + l2) + (st - s) ** 2 / (ct - c + l2) - st**2 / (ct + l2)
            gain[(c < least) | (ct - c < least)] = 0
            gain = gain.reshape(n, -1)
            top = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(n), top] > 1e-12):
                feature[first + k], cut[first + k] = divmod(int(top[k]), bins)
                here = local == k
                node[here] = 2 * (first + k) + 1 + (b[here, feature[first + k]] > cut[first + k])
        size = 2 ** (depth + 1) - 1
        leaf = np.bincount(node, g, size) / (np.bincount(node, minlength=size) + l2)
        return feature, cut, leaf, depth, node

    @staticmethod
    def _walk(tree, b):
        feature, cut, leaf, depth = tree
        node = np.zeros(len(b), int)
        for _ in range(depth):
            for k in np.unique(node):
                if k in feature:
                    here = node == k
                    node[here] = 2 * k + 1 + (b[here, feature[k]] > cut[k])
        return leaf[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + self.rate * sum((self._walk(t, b) for t in self.trees), np.zeros(len(b)))


# ---------------------------------------------------------------- walk-forward


def samples(rows: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """(horizon, h, date, ticker, features, actual) of rows with all features and the target."""
    full = rows.dropna(subset=FEATURES)
    pairs = ", ".join(f"'{label}', {h}, fwd_{h}" for label, h in horizons.items())
    stacked = full.selectExpr("date", "ticker", *FEATURES, f"stack({len(horizons)}, {pairs}) as (horizon, h, actual)")
    return stacked.where("actual is not null")


def folds(data: DataFrame, refit: int = REFIT, least_days: int = MIN_DAYS) -> DataFrame:
    """(horizon, refit_id, train_end, test_start, test_end): a row for each refit. Training dates end 1.6 times the horizon, in calendar days, before the test starts."""
    days = data.select("horizon", "h", "date").distinct()
    w = Window.partitionBy("horizon").orderBy("date")
    at = days.select("*", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("horizon")).alias("n"))
    ends = at.withColumn("test_end", F.coalesce(F.lead("date", refit - 1).over(w), F.max("date").over(Window.partitionBy("horizon"))))
    start = F.lit(least_days) + F.col("h")
    chosen = ends.where((F.col("n") >= start + 10) & (F.col("i") >= start) & ((F.col("i") - start) % refit == 0))
    return chosen.select("horizon", ((F.col("i") - start) / refit).cast("int").alias("refit_id"), F.date_sub("date", F.floor(F.col("h") * 1.6).cast("int")).alias("train_end"), F.col("date").alias("test_start"), "test_end")


def tagged(data: DataFrame, refits: DataFrame) -> DataFrame:
    """data once for each refit that trains on it or tests it (test: whether it tests). Refits are a row for each 42 dates of the calendar."""
    early = F.col("date") <= F.col("train_end")
    inside = F.col("date").between(F.col("test_start"), F.col("test_end"))
    return data.join(F.broadcast(refits), "horizon").where(early | inside).withColumn("test", inside)  # bounded: the calendar over 42


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
SUMS = ["n", "y", *[f"x{i}" for i in range(len(FEATURES))], *[f"xy{i}" for i in range(len(FEATURES))], *[f"x{i}x{j}" for i, j in _PAIRS]]


def gram_sums(data: DataFrame, refits: DataFrame) -> DataFrame:
    """(horizon, refit_id, n, y, x0, ..., xy0, ..., x0x0, ...): sums over the rows that a refit trains on. Each row counts once, at the first refit that may use it; sums up to a refit run over the refits, a row for each."""
    ends = refits.groupBy("horizon").agg(F.array_sort(F.collect_list(F.struct("train_end", "refit_id"))).alias("ends"))
    at = F.size(F.filter("ends", lambda e: e.train_end < F.col("date")))
    rows = data.join(F.broadcast(ends), "horizon").withColumn("refit_id", F.get("ends", at).getField("refit_id")).where("refit_id is not null")  # bounded: a row for each horizon
    terms = ["1.0D", "actual", *FEATURES, *[f"{c} * actual" for c in FEATURES], *[f"{FEATURES[i]} * {FEATURES[j]}" for i, j in _PAIRS]]
    new = rows.groupBy("horizon", "refit_id").agg(*[F.expr(f"sum({t}) as {c}") for c, t in zip(SUMS, terms, strict=True)])
    so_far = "over (partition by horizon order by refit_id rows between unbounded preceding and current row)"
    return refits.select("horizon", "refit_id").join(new, ["horizon", "refit_id"], "left").selectExpr("horizon", "refit_id", *[f"coalesce(sum({c}) {so_far}, 0.0D) as {c}" for c in SUMS])


def ridge_system(sums: DataFrame, *keys: str, alpha: float = 10.0) -> DataFrame:
    """(*keys, system, scale, mean, base) from rows of gram_sums(): the normal equations of standardised features with a penalty on the weights, each row with its right side at the end; the features' standard deviations (1 for one that doesn't vary) and means; the target's mean."""
    p = range(len(FEATURES))
    listed = lambda names: f"array({', '.join(names)})"
    xx = listed(listed(f"x{min(i, j)}x{max(i, j)}" for j in p) for i in p)
    means = sums.selectExpr(*keys, "n", "y / n as base", f"{listed(f'x{i} / n' for i in p)} as mean", f"{xx} as xx", f"{listed(f'xy{i}' for i in p)} as xy")
    sd = "transform(xx, (row, i) -> if(row[i] - n * mean[i] * mean[i] > 1e-12D * row[i], sqrt(greatest(row[i] - n * mean[i] * mean[i], 0.0D) / n), 1.0D))"
    left = f"transform(row, (x, j) -> (x - n * mean[i] * mean[j]) / (scale[i] * scale[j]) + if(i = j, {alpha}D, 0.0D))"
    right = "array((xy[i] - n * mean[i] * base) / scale[i])"
    return means.withColumn("scale", F.expr(sd)).selectExpr(*keys, f"transform(xx, (row, i) -> concat({left}, {right})) as system", "scale", "mean", "base")


def eliminated(rows: Column, p: int) -> Column:
    """Rows of a symmetric positive definite system, each with its right side, in upper triangular form: Cholesky's factorisation without roots, a column at a time."""

    def column(m: Column, k: Column) -> Column:
        top = F.get(m, k)
        below = lambda row: F.zip_with(row, top, lambda x, t: x - t * F.get(row, k) / F.get(top, k))
        return F.transform(m, lambda row, i: F.when(i <= k, row).otherwise(below(row)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), rows, column)


def back_substituted(upper: Column, p: int) -> Column:
    """The solution of upper triangular rows, each with its right side at the end; the last unknown is found first."""

    def unknown(w: Column, k: Column) -> Column:
        row = F.get(upper, k)
        known = F.aggregate(F.zip_with(F.slice(row, k + 2, F.lit(p - 1) - k), w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.concat(F.array((F.get(row, F.lit(p)) - known) / F.get(row, k)), w)

    return F.aggregate(F.sequence(F.lit(p - 1), F.lit(0), F.lit(-1)), F.array().cast("array<double>"), unknown)


def _solved(sums: DataFrame, *keys: str) -> DataFrame:
    """(*keys, w): intercept and weights; of sums over at least MIN_ROWS rows."""
    p = len(FEATURES)
    ready = ridge_system(sums.where(F.col("n") >= MIN_ROWS), *keys)
    upper = ready.withColumn("system", eliminated(F.col("system"), p))
    weights = upper.withColumn("w", F.zip_with(back_substituted(F.col("system"), p), "scale", lambda x, s: x / s))
    intercept = F.col("base") - F.aggregate(F.zip_with("w", "mean", lambda x, m: x * m), F.lit(0.0), lambda s, x: s + x)
    return weights.select(*keys, F.concat(F.array(intercept), F.col("w")).alias("w"))


def _linear() -> Column:
    return F.expr(" + ".join(["w[0]", *[f"{c} * w[{i + 1}]" for i, c in enumerate(FEATURES)]]))


def _by_ridge(data: DataFrame, refits: DataFrame) -> DataFrame:
    fitted = refits.select("horizon", "refit_id", "test_start", "test_end").join(_solved(gram_sums(data, refits), "horizon", "refit_id"), ["horizon", "refit_id"])
    tests = data.join(F.broadcast(fitted), "horizon").where(F.col("date").between(F.col("test_start"), F.col("test_end")))  # bounded: the calendar over 42
    return tests.select("horizon", "refit_id", "date", "ticker", "actual", _linear().alias("prediction"))


def _by_trees(data: DataFrame, refits: DataFrame) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        train, test = group[~group.test].sort_values(["date", "ticker"]), group[group.test]
        out = test[["horizon", "refit_id", "date", "ticker", "actual"]]
        if len(train) < MIN_ROWS or not len(test):
            return out.iloc[:0].assign(prediction=pd.Series(dtype=float))
        return out.assign(prediction=Boosting(train[FEATURES].to_numpy(), train.actual.to_numpy()).predict(test[FEATURES].to_numpy()))

    return tagged(data, refits).groupBy("horizon", "refit_id").applyInPandas(one, "horizon string, refit_id int, date date, ticker string, actual double, prediction double")


def _mean_of(parts: list[DataFrame], value: str, *keys: str) -> DataFrame:
    """The mean of the models' values: their rows are put together and averaged by key."""
    if len(parts) == 1:
        return parts[0]
    return functools.reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.avg(value).alias(value))


def walk_forward(data: DataFrame, refits: DataFrame | None = None, model: str = "ensemble") -> DataFrame:
    """(horizon, refit_id, date, ticker, actual, prediction) out of sample: of the mean of both models, or of one ("ridge", "boosting"); refits with under 200 rows to train on are skipped."""
    refits = written(data.sparkSession, folds(data) if refits is None else refits, "refits")  # every model reads it more than once
    made = [f(data, refits) for name, f in (("ridge", _by_ridge), ("boosting", _by_trees)) if model in (name, "ensemble")]
    return _mean_of(made, "prediction", "horizon", "refit_id", "date", "ticker", "actual")


def rank_correlation(rows: DataFrame, a: str, b: str, *by: str, least: int = 8) -> DataFrame:
    """(*by, n, rho) of groups with at least so many rows; null where a side doesn't vary."""
    ranked = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, average_rank(a, *by).alias("ra"), average_rank(b, *by).alias("rb"))
    vary = (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(vary, F.corr("ra", "rb")).alias("rho"))
    return out.where(F.col("n") >= least)


def ic_summary(oos: DataFrame) -> DataFrame:
    """(horizon, ic, t_stat, n, mode) of (horizon, date, prediction, actual): the mean rank correlation of at least 20 dates with 8 names or more, else that of all rows; 0 below 50 rows."""
    size = oos.groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"))
    daily = rank_correlation(oos, "prediction", "actual", "horizon", "date").where("rho is not null").groupBy("horizon").agg(F.avg("rho").alias("m"), F.stddev_samp("rho").alias("sd"), F.count("rho").alias("days"))
    pooled = rank_correlation(oos, "prediction", "actual", "horizon", least=2).select("horizon", "rho")
    all_ = size.join(daily, "horizon", "left").join(pooled, "horizon", "left")
    cross, few = F.coalesce(F.col("days") >= 20, F.lit(False)), F.col("rows") < 50
    n_eff = F.greatest(F.lit(2.0), F.col("rows") / 21.0)
    t_cross = F.when(F.col("sd") > 0, F.col("m") / F.nullif(F.col("sd") / F.sqrt("days"), F.lit(0.0))).otherwise(0.0)
    t_pool = F.coalesce(F.col("rho") * F.sqrt(n_eff - 2) / F.sqrt(F.greatest(F.lit(1e-9), 1 - F.col("rho") ** 2)), F.lit(0.0))
    pick = lambda a, b, c: F.when(few, a).when(cross, b).otherwise(c)
    return all_.select(
        "horizon", pick(F.lit(0.0), F.col("m"), F.coalesce("rho", F.lit(0.0))).alias("ic"), pick(F.lit(0.0), t_cross, t_pool).alias("t_stat"),
        pick(F.col("rows"), F.col("days"), F.col("rows")).alias("n"), pick(F.lit(None).cast("string"), F.lit("cross_sectional"), F.lit("pooled_time_series")).alias("mode"),
    )


def skill_weight(ic):
    """Trust in a model by its information coefficient: none at zero or below, a half at most."""
    return F.least(F.greatest(ic * 5.0, F.lit(0.0)), F.lit(0.5))


def residual_bounds(oos: DataFrame) -> DataFrame:
    """(horizon, low, high): 5 % and 95 % of what came minus what was predicted, of horizons with over 60 rows."""
    left = oos.select("horizon", (F.col("actual") - F.col("prediction")).alias("left"))
    return quantiles(left, ["horizon"], "left", [0.05, 0.95]).where("n > 60").select("horizon", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def latest(rows: DataFrame) -> DataFrame:
    """Rows of the last date with a 63-day momentum."""
    return rows.where(F.col("d_idx") == rows.agg(F.max("d_idx")).scalar()).where("mom_63 is not null")


def market_base(market: DataFrame) -> DataFrame:
    """One row: the mean market return (column mkt) of the last 252 dates that have one."""
    return market.where("mkt is not null").orderBy(F.desc("d_idx")).limit(252).agg(F.coalesce(F.avg("mkt"), F.lit(0.0)).alias("base"))


def final_forecasts(data: DataFrame, now: DataFrame, model: str = "ensemble") -> DataFrame:
    """(horizon, ticker, raw): models of each horizon fitted on all its rows, for the latest features, missing ones as zero."""
    new = now.select("ticker", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES])
    made = []
    if model in ("ridge", "ensemble"):
        whole = data.groupBy("horizon").agg(F.lit(0).alias("refit_id"), F.max("date").alias("train_end"))
        fitted = _solved(gram_sums(data, whole), "horizon")
        made.append(new.join(F.broadcast(fitted)).select("horizon", "ticker", _linear().alias("raw")))  # bounded: the horizons
    if model in ("boosting", "ensemble"):
        wanted = new.join(F.broadcast(data.select("horizon").distinct()))  # bounded: the horizons

        def one(group: pd.DataFrame) -> pd.DataFrame:
            train, test = group[group.actual.notna()].sort_values(["date", "ticker"]), group[group.actual.isna()]
            raw = Boosting(train[FEATURES].to_numpy(), train.actual.to_numpy()).predict(test[FEATURES].to_numpy()) if len(train) and len(test) else []
            return test[["horizon", "ticker"]].assign(raw=raw)

        both = data.select("horizon", "date", "ticker", "actual", *FEATURES).unionByName(wanted, allowMissingColumns=True)
        made.append(both.groupBy("horizon").applyInPandas(one, "horizon string, ticker string, raw double"))
    return _mean_of(made, "raw", "horizon", "ticker")


def blended(now: DataFrame, horizons: DataFrame, raw: DataFrame) -> DataFrame:
    """Forecasts in percent: the market's mean plus the model's difference from it, weighted by skill.

    horizons: (horizon, h, base, skill_weight, low, high); raw: (horizon, ticker, raw), whose absence means the market's mean.
    """
    base = F.col("base") * F.col("h")
    all_ = now.select("ticker").join(F.broadcast(horizons)).join(raw, ["horizon", "ticker"], "left").withColumn("raw", F.coalesce("raw", base))  # bounded: the horizons
    mix = base + F.col("skill_weight") * (F.col("raw") - base)
    pct = lambda x: F.bround(100 * (F.exp(x) - 1), 2)
    return all_.select("ticker", "horizon", pct(mix).alias("expected_return_pct"), pct(F.col("raw")).alias("raw_model_return_pct"), pct(mix + F.col("low")).alias("low_5pct"), pct(mix + F.col("high")).alias("high_95pct"), "skill_weight")


def horizon_table(oos: DataFrame, horizons: dict[str, int], market: DataFrame) -> DataFrame:
    """(horizon, h, base, skill_weight, low, high, oos_samples, ic, t_stat, n, mode): a row for each horizon, with what blended() needs; no forecasts out of sample, no trust in the model."""
    named = oos.sparkSession.createDataFrame(list(horizons.items()), "horizon string, h int")
    sizes = oos.groupBy("horizon").agg(F.count(F.lit(1)).alias("oos_samples"))
    all_ = named.join(sizes, "horizon", "left").join(ic_summary(oos), "horizon", "left").join(residual_bounds(oos), "horizon", "left")
    trust = F.coalesce(skill_weight(F.col("ic")), F.lit(0.0))
    return all_.select("horizon", "h", market_base(market).scalar().alias("base"), trust.alias("skill_weight"), "low", "high", F.coalesce("oos_samples", F.lit(0)).alias("oos_samples"), "ic", "t_stat", "n", "mode")


# What a feature of high rank is called in reasons.
REASONS = {
    "mom_63": "momentum 3 mois fort", "mom_126": "momentum 6 mois fort", "mom_21": "momentum 1 mois fort", "dist_52w_high": "proche de son plus-haut 52 semaines",
    "reversal_5": "rebond apres baisse recente", "vol_63": "volatilite maitrisee", "amihud": "prime d'illiquidite a capter", "volume_shock": "regain de volume anormal",
}
NO_REASON = "profil equilibre"


def reasons(now: DataFrame) -> DataFrame:
    """(ticker, pourquoi): the three features in which the ticker ranks highest, if over 0.6, by name; ties in the order of FEATURES."""
    order = F.create_map(*[x for i, f in enumerate(FEATURES) for x in (F.lit(f), F.lit(i))])
    label = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    cells = now.unpivot(["ticker"], FEATURES, "feature", "x").where("x is not null").withColumn("o", order[F.col("feature")])
    ranked = cells.withColumn("rank", average_rank("x", "feature") / F.count(F.lit(1)).over(Window.partitionBy("feature")))
    top = ranked.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("rank"), "o"))).where("k <= 3 and rank > 0.6")
    named = top.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce(label[F.col("feature")], F.col("feature")).alias("l")))), lambda s: s.l), "; ").alias("pourquoi"))
    return now.select("ticker").join(named, "ticker", "left").select("ticker", F.coalesce("pourquoi", F.lit(NO_REASON)).alias("pourquoi"))


def top_ten(forecasts: DataFrame, now: DataFrame, horizon: str = "3M", n: int = 10) -> DataFrame:
    """The n best forecasts of a horizon, with reasons; ties by ticker."""
    best = forecasts.where(F.col("horizon") == horizon).orderBy(F.desc("expected_return_pct"), "ticker").limit(n)
    return best.join(reasons(now), "ticker", "left").orderBy(F.desc("expected_return_pct"), "ticker")


def quarterly(oos: DataFrame, every: int = 63, n: int = 10, least: int = 12) -> DataFrame:
    """(quarters, mean_quarterly_excess_pct, t_stat, positive_share): every 63rd date, what the ten best predictions earned over all; only the count below three quarters."""
    w = Window.orderBy("date")  # a row for each date
    days = oos.select("date").distinct().withColumn("i", F.row_number().over(w) - 1).where(F.col("i") % every == 0).select("date")
    d = Window.partitionBy("date")
    ranked = oos.join(F.broadcast(days), "date").select("date", "actual", F.row_number().over(d.orderBy(F.desc("prediction"), "ticker")).alias("k"), F.count(F.lit(1)).over(d).alias("size")).where(F.col("size") >= least)  # bounded: the calendar over 63
    q = ranked.groupBy("date").agg((F.avg(F.when(F.col("k") <= n, F.col("actual"))) - F.avg("actual")).alias("x"))
    s = q.agg(F.count("x").alias("quarters"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.avg((F.col("x") > 0).cast("double")).alias("share"))
    enough = F.col("quarters") >= 3
    t = F.when(F.col("sd") > 0, F.col("m") / F.nullif(F.col("sd") / F.sqrt("quarters"), F.lit(0.0))).otherwise(0.0)
    return s.select("quarters", F.when(enough, F.col("m") * 100).alias("mean_quarterly_excess_pct"), F.when(enough, t).alias("t_stat"), F.when(enough, F.col("share")).alias("positive_share"))


def _mixture(row: Column) -> tuple[Column, Column]:
    """(chance of the first normal, logarithm of the density) of x under row: (share, m0, v0, m1, v1)."""
    x = F.col("x")
    part = lambda share, m, v: F.ln(share) - F.ln(2 * pi * v) / 2 - (x - m) * (x - m) / (2 * v)
    first, second = part(row["share"], row["m0"], row["v0"]), part(1 - row["share"], row["m1"], row["v1"])
    return 1 / (1 + F.exp(second - first)), F.greatest(first, second) + F.ln(1 + F.exp(-F.abs(first - second)))


def _maximised(rows: DataFrame, chance: Column, fit: Column) -> tuple:
    """The mixture that fits best given each row's chance to be of the first normal: sums over all rows. Then the number of rows, and the mean of fit."""
    r = rows.select("x", chance.alias("r"), fit.alias("l"))
    x, p = F.col("x"), F.col("r")
    s = r.agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("n0"), F.sum(p * x).alias("s0"), F.sum(p * x * x).alias("q0"), F.sum((1 - p) * x).alias("s1"), F.sum((1 - p) * x * x).alias("q1"), F.avg("l").alias("l")).first()
    n0, n1 = (max(v, LEAST_SHARE) for v in (s.n0, s.n - s.n0))
    m0, m1 = s.s0 / n0, s.s1 / n1
    return (n0 / (n0 + n1), m0, max(s.q0 / n0 - m0 * m0, 0.0) + LEAST_SPREAD, m1, max(s.q1 / n1 - m1 * m1, 0.0) + LEAST_SPREAD), s.n, s.l


def two_normals(rows: DataFrame, tolerance: float = 1e-5, rounds: int = 200) -> tuple[float, float, float, float, float] | None:
    """(share, m0, v0, m1, v1) of the mixture of two normals that x follows, by expectation and maximisation; a round is one sum over the rows.

    It starts from the rows nearer to the mean than half of them are, against the others, and stops once the mean
    logarithm of the density grows by less than tolerance. None without rows.
    """
    spark = rows.sparkSession
    centre = rows.agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not centre.n:
        return None
    reach = rows.agg(F.percentile(F.abs(F.col("x") - centre.m), 0.5).alias("d")).first().d
    now, _, _ = _maximised(rows, (F.abs(F.col("x") - centre.m) <= reach).cast("double"), F.lit(0.0))
    last = None
    for _ in range(rounds):
        at = spark.createDataFrame([now], "share double, m0 double, v0 double, m1 double, v1 double")
        chance, fit = _mixture({c: F.col(c) for c in at.columns})
        new, _, level = _maximised(rows.join(F.broadcast(at)), chance, fit)  # bounded: one row
        if last is not None and level - last < tolerance:
            break
        now, last = new, level
    return now


def market_regime(market: DataFrame) -> DataFrame:
    """(regime, calm_probability, calm_ann_vol, stress_ann_vol) in one row: is the market calm or stressed, by the last 21 dates' mean chance of the calmer of two normals. "inconnu" and nulls below 120 dates."""
    spark, schema = market.sparkSession, "regime string, calm_probability double, calm_ann_vol double, stress_ann_vol double"
    rows = written(spark, market.where("mkt is not null").select("d_idx", F.col("mkt").alias("x")), "market")
    if rows.count() < 120:
        return spark.createDataFrame([("inconnu", None, None, None)], schema)
    share, m0, v0, m1, v1 = two_normals(rows)
    chance, _ = _mixture({"share": F.lit(share), "m0": F.lit(m0), "v0": F.lit(v0), "m1": F.lit(m1), "v1": F.lit(v1)})
    recent = rows.orderBy(F.desc("d_idx")).limit(21).agg(F.avg(chance if v0 <= v1 else 1 - chance).alias("calm"))
    name = F.when(F.col("calm") > 0.5, "CALME").otherwise("STRESS").alias("regime")
    return recent.select(name, F.col("calm").alias("calm_probability"), F.lit(sqrt(min(v0, v1) * 252)).alias("calm_ann_vol"), F.lit(sqrt(max(v0, v1) * 252)).alias("stress_ann_vol"))
