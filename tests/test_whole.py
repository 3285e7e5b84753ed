"""Queries that do the whole job: all tickers, factors, replicates and horizons; and those without SQL against brute force."""

from __future__ import annotations

from math import sqrt
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fathom.operators import backtest, forecast, portfolio
from fathom.operators.factors import NAMES
from fathom.operators.features import FEATURES
from fathom.plans import queries as plans

from .conftest import SF
from .test_queries import rows

DAILY = SF.replace("sf0.001", "sf0.01")


def test_unpivot_has_all_tickers(spark, duck):
    got = {r.ticker for r in entry.queries()["unpivot_wide"](spark, SF).select("ticker").distinct().collect()}
    assert got == {x for (x,) in duck.execute("select distinct p_brand from lineitem join part on l_partkey = p_partkey").fetchall()}
    assert len(got) > 3


@pytest.fixture(scope="module")
def daily():
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '{DAILY}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def samples(spark):
    return plans._daily_samples(spark, DAILY).persist()


def test_ridge_by_normal_equations(spark, samples):
    """Every refit of every horizon against least squares on the rows themselves."""
    refits = forecast.folds(samples)
    got = forecast.walk_forward(samples, refits, "ridge").toPandas()
    assert set(got.groupby("horizon").refit_id.nunique() > 20) == {True} and set(got.horizon) == {"1M", "3M", "6M", "12M"}
    data, folds = samples.toPandas(), refits.toPandas()
    for f in folds.itertuples():
        if f.refit_id % 9:
            continue
        own = data[data.horizon == f.horizon]
        train, test = own[own.date <= f.train_end], own[(own.date >= f.test_start) & (own.date <= f.test_end)]
        if len(train) < 200:
            assert not ((got.horizon == f.horizon) & (got.refit_id == f.refit_id)).any()
            continue
        x, y = train[FEATURES].to_numpy(), train.actual.to_numpy()
        mean, sd = x.mean(axis=0), x.std(axis=0)
        z = (x - mean) / np.where(sd > 0, sd, 1)
        w = np.linalg.solve(z.T @ z + 10 * np.eye(len(FEATURES)), z.T @ (y - y.mean()))
        want = y.mean() + (test[FEATURES].to_numpy() - mean) / np.where(sd > 0, sd, 1) @ w
        mine = got[(got.horizon == f.horizon) & (got.refit_id == f.refit_id)].set_index(["date", "ticker"]).prediction
        np.testing.assert_allclose(mine.loc[list(zip(test.date, test.ticker, strict=True))], want, atol=1e-7)


def test_forecasts_of_the_last_date(spark, samples):
    now = spark.createDataFrame([("A", *[0.1] * 12), ("B", *[None] * 12)], "ticker string, " + ", ".join(f"{f} double" for f in FEATURES))
    got = forecast.final_forecasts(samples, now, "ridge").toPandas()
    data = samples.toPandas()
    for r in got.itertuples():
        own = data[data.horizon == r.horizon]
        x, y = own[FEATURES].to_numpy(), own.actual.to_numpy()
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        w = np.linalg.solve(z.T @ z + 10 * np.eye(12), z.T @ (y - y.mean()))
        new = np.full(12, 0.1 if r.ticker == "A" else 0.0)
        assert r.raw == pytest.approx(y.mean() + (new - x.mean(axis=0)) / x.std(axis=0) @ w, abs=1e-7)
    assert len(got) == 8


def test_ensemble_is_the_mean_of_both(spark, samples):
    some = samples.where("horizon = '12M'")
    refits = forecast.folds(some).where("refit_id in (0, 7)")
    key = ["refit_id", "date", "ticker"]
    parts = [forecast.walk_forward(some, refits, m).toPandas().set_index(key).prediction for m in ("ridge", "boosting", "ensemble")]
    np.testing.assert_allclose(parts[2], (parts[0] + parts[1])[parts[2].index] / 2, atol=1e-12)
    assert len(parts[2]) > 100


def test_alpha_by_hand(spark, samples):
    """Skill, shrinkage and bounds of every horizon and forecast, from the out-of-sample forecasts themselves."""
    oos = forecast.walk_forward(samples, model="ridge").toPandas()
    market = plans.panels.market_series(plans.panel_of(spark, DAILY)).toPandas().dropna().sort_values("d_idx").mkt
    base = market.tail(252).mean()
    table = {r.horizon: r for r in plans.QUERIES["alpha_horizons"](spark, DAILY).collect()}
    got = plans.QUERIES["alpha_forecasts"](spark, DAILY).toPandas()
    for name, h in plans.features.HORIZONS.items():
        own, r = oos[oos.horizon == name], table[name]
        days = [(len(d), d.prediction.rank().corr(d.actual.rank())) for _, d in own.groupby("date")]
        rho = np.array([x for n, x in days if n >= 8 and x == x])
        ic = rho.mean() if len(rho) >= 20 else own.prediction.rank().corr(own.actual.rank())
        low, high = np.quantile(own.actual - own.prediction, [0.05, 0.95])
        assert (r.h, r.oos_samples) == (h, len(own)) and r.ic == pytest.approx(ic, abs=1e-5) and (r.low, r.high) == (pytest.approx(low, abs=1e-5), pytest.approx(high, abs=1e-5))
        weight = min(max(5 * ic, 0), 0.5)
        assert r.skill_weight == pytest.approx(weight, abs=1e-5) and r.base == pytest.approx(base, abs=1e-6)
        for f in got[got.horizon == name].itertuples():
            raw = np.log1p(f.raw_model_return_pct / 100)
            mix = base * h + weight * (raw - base * h)
            of = lambda x: pytest.approx(100 * (np.exp(x) - 1), rel=2e-3, abs=0.02)  # noqa: E731  raw is known to two places only
            assert (f.expected_return_pct, f.low_5pct, f.high_95pct) == (of(mix), of(mix + low), of(mix + high))
    assert set(got.horizon) == set(table) and got.ticker.nunique() > 10
    best = got[got.horizon == "3M"].sort_values(["expected_return_pct", "ticker"], ascending=[False, True]).head(10)
    top = plans.QUERIES["alpha_top10"](spark, DAILY).toPandas()
    assert sorted(top.Valeur) == sorted(best.ticker) and top.Pourquoi.str.len().min() > 0


def test_trees_learn(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 12))
    y = np.where(x[:, 3] > 0, 1.0, -1.0) * (x[:, 5] > 0.5) + rng.normal(0, 0.1, 2000)
    made = forecast.Boosting(x[:1500], y[:1500]).predict(x[1500:])
    assert np.corrcoef(made, y[1500:])[0, 1] > 0.9


def naive_order(dist: np.ndarray) -> list[int]:
    """Single linkage by its definition: again and again the two clusters with the nearest members join; the one made first stands left."""
    clusters = [(i, [i]) for i in range(len(dist))]
    made = len(dist)
    while len(clusters) > 1:
        _, i, j = min((dist[np.ix_(a, b)].min(), i, j) for i, (_, a) in enumerate(clusters) for j, (_, b) in enumerate(clusters) if i < j)
        (x, a), (y, b) = sorted((clusters[i], clusters[j]))
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [(made, a + b)]
        made += 1
    return clusters[0][1]


def naive_hrp(x: np.ndarray) -> np.ndarray:
    n, p = x.shape
    z = x - x.mean(axis=0)
    s = z.T @ z / n
    mu = np.trace(s) / p
    far = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / p
    cov = s + min(noise, far) / far * (mu * np.eye(p) - s)
    sd = np.sqrt(np.diag(cov))
    dist = np.sqrt(np.clip((1 - cov / np.outer(sd, sd)) / 2, 0, 1))
    np.fill_diagonal(dist, 0)
    w = np.ones(p)

    def risk(items):
        inv = 1 / np.diag(cov)[items]
        return inv @ cov[np.ix_(items, items)] @ inv / inv.sum() ** 2

    def split(items):
        if len(items) > 1:
            a, b = items[: len(items) // 2], items[len(items) // 2 :]
            share = risk(b) / (risk(a) + risk(b))
            w[a] *= share
            w[b] *= 1 - share
            split(a)
            split(b)

    split(naive_order(dist))
    return w / w.sum()


def test_risk_parity_by_naive_linkage(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.01, (180, 3))
    x = np.column_stack([base @ rng.dirichlet([1, 1, 1]) + rng.normal(0, 0.003 * (1 + i % 4), 180) for i in range(11)])
    table = [("p", f"S{i:02}", d, float(x[d, i])) for i in range(11) for d in range(180)] + [("p", "THIN", d, 0.01 if d < 50 else None) for d in range(180)] + [("q", "ONE", d, 0.01 * (d % 3)) for d in range(9)]
    returns = spark.createDataFrame(table, "portfolio string, ticker string, d_idx long, ret double")
    got = {(r.portfolio, r.ticker): r.weight for r in portfolio.hrp_weights(returns).collect()}
    assert got.pop(("q", "ONE")) == 1.0
    np.testing.assert_allclose([got[k] for k in sorted(got)], naive_hrp(x), rtol=1e-8)
    assert portfolio.hrp_weights(returns.limit(0)).count() == 0
    sizes = plans.QUERIES["hrp_portfolio"](spark, DAILY).toPandas()
    assert 0 < sizes.weight_pct.sum() <= 100 and sizes.weight_pct.max() < 25


def test_deflated_sharpe_by_hand(spark):
    got = {r.strategy: r for r in entry.queries()["deflated_sharpe"](spark, DAILY).collect()}
    net = backtest.net_returns(plans.panel_of(spark, DAILY), list(NAMES)).toPandas()
    assert set(got) == set(NAMES)
    normal, n_trials, g = NormalDist(), len(NAMES), 0.5772156649
    for name, x in net.groupby("strategy").net:
        sr, d = x.mean() / x.std(), x - x.mean()
        skew, kurt = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2
        sd = sqrt((1 - skew * sr + (kurt - 1) / 4 * sr**2) / (len(x) - 1))
        bar = sd * ((1 - g) * normal.inv_cdf(1 - 1 / n_trials) + g * normal.inv_cdf(1 - 1 / (n_trials * np.e)))
        assert got[name].dsr == pytest.approx(normal.cdf((sr - bar) / sd), abs=1e-5)
        assert got[name].threshold_from_n_trials == pytest.approx(bar * sqrt(252), abs=1e-5)


def test_gates(spark, daily):
    """The report's gates follow from the whole queries' numbers, which have SQL."""
    got = {r.gate: r.passed for r in entry.queries()["deployment_gates"](spark, DAILY).collect()}
    assert list(got) == ["sharpe_positive", "beats_baseline_ci", "reality_check_significant", "deflated_sharpe_solid"]
    perf = daily.execute(entry.oracle_sql()["performance_table"]).df().set_index("strategy").sharpe.drop("baseline_equal_weight")
    best = perf.idxmax()
    ci = daily.execute(entry.oracle_sql()["bootstrap_iid"]).df().set_index("strategy").ci05
    p = daily.execute(entry.oracle_sql()["reality_check_p_value"]).df().p_value[0]
    assert (got["sharpe_positive"], got["beats_baseline_ci"], got["reality_check_significant"]) == (perf[best] > 0, ci[best] > 0, p < 0.05)
    dsr = {r.strategy: r.dsr for r in entry.queries()["deflated_sharpe"](spark, DAILY).collect()}
    assert got["deflated_sharpe_solid"] == (dsr[best] > 0.9)


def test_regime_finds_the_calm(spark):
    from fathom.operators.forecast import market_regime

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.03, 300), rng.normal(0, 0.004, 300)])
    market = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "d_idx long, mkt double")
    got = market_regime(market).first().asDict()
    assert got["regime"] == "CALME" and got["calm_probability"] > 0.5
    assert got["calm_ann_vol"] == pytest.approx(0.004 * sqrt(252), rel=0.25) and got["stress_ann_vol"] == pytest.approx(0.03 * sqrt(252), rel=0.25)
    assert market_regime(market.where("d_idx < 300")).first().regime in ("CALME", "STRESS") and tuple(market_regime(market.limit(50)).first()) == ("inconnu", None, None, None)
    assert tuple(market_regime(market.limit(0)).first()) == ("inconnu", None, None, None)


def test_pivot_means_duplicates(spark):
    from datetime import date

    from fathom.operators import panel

    days = [date(2025, 1, d) for d in (2, 3)]
    p = spark.createDataFrame([(days[0], "A", 10.0, 1.0), (days[0], "A", 20.0, 3.0), (days[1], "A", 30.0, None), (days[1], "B", 5.0, 2.0)], "date date, ticker string, close double, volume double")
    got = {(r.ticker, r.d_idx): (r.close, r.volume) for r in panel.to_panel(p).collect()}
    assert got == {("A", 0): (15.0, 2.0), ("A", 1): (30.0, None), ("B", 0): (None, None), ("B", 1): (5.0, 2.0)}


def test_top_ten_has_reasons_and_labels(spark):
    from fathom.operators import dashboard

    now = spark.createDataFrame([(f"T{i:02}", *[float(i + j) for j in range(12)]) for i in range(14)], "ticker string, " + ", ".join(f"{f} double" for f in FEATURES))
    f = now.select("ticker", F.lit("3M").alias("horizon"), F.col("mom_63").alias("expected_return_pct"), F.lit(-1.0).alias("low_5pct"), F.lit(9.0).alias("high_95pct"))
    got = dashboard.top_ten(forecast.top_ten(f, now)).toPandas()
    assert list(got.columns) == ["Valeur", "Prevision 3M %", "Pire cas 5%", "Meilleur cas 95%", "Pourquoi"]
    assert list(got.Valeur) == [f"T{i:02}" for i in range(13, 3, -1)]
    assert got.Pourquoi[0] == "momentum 1 mois fort; momentum 3 mois fort; momentum 6 mois fort"
    skill = dashboard.horizon_skill(spark, {"horizons": {"1M": {"oos_samples": 7, "skill": {"ic": 0.12345, "t_stat": 1.005}, "forecast_shrinkage": 0.5}, "3M": {"skill": None}}}).collect()
    assert [tuple(r) for r in skill] == [("1M", 7, 0.123, 1.0, 50), ("3M", 0, 0.0, 0.0, 0)]


def test_folds_of_every_horizon(spark, daily):
    assert rows(entry.queries()["purged_folds"](spark, DAILY).toPandas()) == rows(daily.execute(entry.oracle_sql()["purged_folds"]).df())
    assert pd.DataFrame(entry.queries()["ridge_sums"](spark, DAILY).toPandas()).horizon.nunique() == 4
