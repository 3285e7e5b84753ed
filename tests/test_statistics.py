"""Distribution functions against Python's own and closed forms; resampling against draws taken one by one."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import quantiles as quantiles_of
from fathom.functions import stats
from fathom.operators import inference
from fathom.operators.factors import NAMES

Z = [-30.0, -8.0, -3.0, -2.5, -2.4, -1.0, -1e-9, 0.0, 0.3, 1.0, 2.49, 2.5, 2.51, 5.0, 20.0, 37.0]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", f(F.col("v")).alias("f")).collect()
    return [r.f for r in sorted(rows)]


def test_normal(spark):
    np.testing.assert_allclose(column(spark, Z, stats.normal_sf), [math.erfc(z / math.sqrt(2)) / 2 for z in Z], rtol=1e-12)
    np.testing.assert_allclose(column(spark, Z, stats.normal_cdf), [math.erfc(-z / math.sqrt(2)) / 2 for z in Z], rtol=1e-12)
    np.testing.assert_allclose(column(spark, Z, stats.two_sided_p), [math.erfc(abs(z) / math.sqrt(2)) for z in Z], rtol=1e-12)
    p = [1e-200, 1e-20, 1e-4, 0.01, 0.3, 0.5, 0.7, 0.99, 1 - 1e-10]
    np.testing.assert_allclose(column(spark, p, stats.normal_ppf), [NormalDist().inv_cdf(x) for x in p], rtol=1e-9, atol=1e-15)
    assert column(spark, [0.0, 1.0, None, -0.1], stats.normal_ppf) == [-math.inf, math.inf, None, None]
    assert column(spark, [None], stats.normal_sf) == [None]


@pytest.mark.parametrize("df", [1, 2, 3, 7, 10, 50, 201])
def test_chi_squared(spark, df):
    """By the recurrence from one or two degrees of freedom."""

    def want(x):
        h, a = x / 2, 0.5 if df % 2 else 1.0
        q = math.erfc(math.sqrt(h)) if df % 2 else math.exp(-h)
        while a < df / 2:
            q += math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if h else 0
            a += 1
        return q

    x = [0.0, 0.1, 1.0, 3.0, 10.0, 30.0, 100.0, 400.0]
    np.testing.assert_allclose(column(spark, x, lambda c: stats.chi2_sf(c, df)), list(map(want, x)), rtol=1e-11)


def net_of(spark, series):
    return spark.createDataFrame([(s, d, float(v)) for s, x in series.items() for d, v in enumerate(x)], "strategy string, d_idx long, net double")


def test_deflated_sharpe_knows_luck(spark):
    rng = np.random.default_rng(4)
    net = net_of(spark, {"lucky": rng.normal(0.0004, 0.01, 400), "short": rng.normal(0, 1, 59), "still": [0.0] * 100})
    many, one = ({r.strategy: r for r in inference.deflated_sharpe(net, n).collect()} for n in (100, 1))
    assert 0 < many["lucky"].dsr < one["lucky"].dsr == 1.0 and many["lucky"].n_trials == 100
    assert all(r[k].dsr == 0.0 and r[k].daily_sharpe is None for r in (many, one) for k in ("short", "still"))


@pytest.mark.parametrize(("n", "block"), [(61, 10), (70, 10), (60, 7), (64, 64), (63, 1)])
def test_blocks_by_single_days(spark, n, block):
    """Sums of circular blocks, and the maxima of a family, day by day."""
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.01, (n, 3))
    x[5, 1] = np.nan
    rows = spark.createDataFrame([(f"s{j}", i, float(x[i, j])) for i in range(n) for j in range(3) if x[i, j] == x[i, j]], "strategy string, k long, x double")
    names = ["s0", "s1", "s2"]
    x = np.nan_to_num(x)
    got = {(r.k, r.part): [r.s0, r.s1, r.s2] for r in inference.block_sums(inference.by_place(rows, names, "k")[0].na.fill(0.0), names, block).collect()}
    last = (n - 1) % block + 1
    for k in range(n):
        for part, length in ((0, block), (1, last)):
            np.testing.assert_allclose(got[k, part], x[(k + np.arange(length)) % n].sum(axis=0), atol=1e-12)
    reps, blocks = 9, -(-n // block)
    draw = lambda rep, i: ((rep * 7919 + i * 104729 + 106 * 611953) % 2147483647 * 48271 % 2147483647 * 69621) % 2147483647 % n
    for r in inference.family_maxima(rows, reps, block=block, names=names).collect():
        at = np.concatenate([(draw(r.rep, b + blocks) + np.arange(block)) % n for b in range(blocks)])[:n]
        assert r.stat == pytest.approx((x[at].mean(axis=0) - x.mean(axis=0)).max() * math.sqrt(n), abs=1e-10)


def test_reality_check_of_short_and_tied_families(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.001, 0.01, 80)
    active = lambda n: net_of(spark, {"b": x[:n], "a": x[:n], "c": x[:n] - 0.01}).withColumnRenamed("net", "x")
    assert inference.reality_check(active(59), 20).collect() == []
    assert inference.reality_check(active(0), 20).collect() == []
    got = inference.reality_check(active(80), 20).first()
    assert got.best_factor == "a" and got.factors_in_family == 3 and got.statistic == pytest.approx(math.sqrt(80) * x.mean())
    assert 1 / 21 <= got.p_value <= 1


def test_gates_need_every_number(spark):
    perf = spark.createDataFrame([(n, None if i else 0.5) for i, n in enumerate(NAMES)], "strategy string, sharpe double")
    boot = spark.createDataFrame([(n, 0.1) for n in NAMES], "strategy string, ci05 double")
    check = spark.createDataFrame([(0.01,)], "p_value double")
    dsr = spark.createDataFrame([(n, 0.95) for n in NAMES], "strategy string, dsr double")
    passed = lambda *t: {r.gate: r.passed for r in inference.gates(*t).collect()}
    assert passed(perf, boot, check, dsr) == dict.fromkeys(inference.GATES, True)
    assert {r.strategy for r in inference.gates(perf, boot, check, dsr).collect()} == {NAMES[0]}
    none = passed(perf, boot.limit(0), check.limit(0), dsr.limit(0))
    assert none == {"sharpe_positive": True, "beats_baseline_ci": False, "reality_check_significant": False, "deflated_sharpe_solid": False}


@pytest.mark.parametrize("shares", [[0.05, 0.95], [0.0, 0.5, 1.0], [0.25]])
def test_quantiles_by_selection(spark, shares, monkeypatch):
    rng = np.random.default_rng(7)
    groups = {"normal": rng.normal(0, 1, 3000), "wide": np.exp(rng.normal(0, 80, 500)) * rng.choice([-1, 1], 500), "ties": rng.integers(0, 3, 800).astype(float), "one": [2.5], "two": [1.0, 4.0], "same": [7.0] * 90, "huge": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0]}
    rows = [(g, None if k % 2 else "b", float(v)) for g, x in groups.items() for k, v in enumerate(np.repeat(x, 1))] + [("none", "b", None)]
    table = spark.createDataFrame(rows, "g string, h string, v double").repartition(5)
    monkeypatch.setattr(quantiles_of, "BINS", 16)
    got = {r.g: (r.n, r.q) for r in quantiles_of.quantiles(table, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        x = np.sort(np.array(x))
        at = np.array(shares) * (len(x) - 1)
        low, high = x[np.floor(at).astype(int)], x[np.ceil(at).astype(int)]
        assert got[g][0] == len(x)
        with np.errstate(over="ignore"):
            np.testing.assert_allclose(got[g][1], np.where(low == high, low, low + (high - low) * (at - np.floor(at))), rtol=1e-12)
