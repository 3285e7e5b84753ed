"""Distribution functions that Spark lacks, as columns: series and continued fractions folded over a fixed number of terms, so they stay in the plan."""

from __future__ import annotations

from collections.abc import Callable
from math import e, lgamma, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Euler's constant as the deflated ratio uses it, and the least variance of a Sharpe ratio.
EULER = 0.5772156649
LEAST_VARIANCE = 1e-12
#: Beyond this the tail of the normal comes from its continued fraction, below from a series; both with so many terms.
SPLIT = 2.5
TERMS = 80
STEPS = 14


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(steps: int, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step(state, k) for k = steps, ..., 1."""
    return F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), start, step)


def _density(z: Column) -> Column:
    return F.exp(-z * z / 2) / sqrt(2 * pi)


def _upper(a: Column) -> Column:
    """P(Z > a) for a >= 0: a half less the series a + a^3/3 + a^5/15 + ..., or Mills' ratio 1/(a + 1/(a + 2/(a + ...))), each times the density."""
    series = a * fold(TERMS, F.lit(1.0), lambda s, k: 1 + s * a * a / (2 * k + 1))
    mills = 1 / (a + fold(TERMS, F.lit(0.0), lambda s, k: k / (a + s)))
    return F.when(a < SPLIT, 0.5 - _density(a) * series).otherwise(_density(a) * mills)


def normal_sf(z: Column) -> Column:
    """P(Z > z); small tails keep their digits."""
    return let(z.cast("double"), lambda x: let(_upper(F.abs(x)), lambda q: F.when(x >= 0, q).otherwise(1 - q)))


def normal_cdf(z: Column) -> Column:
    return normal_sf(-z)


def normal_ppf(p: Column) -> Column:
    """z with P(Z <= z) = p, by Newton's steps on the logarithm of the tail, which is concave, so they close in from one side; infinite at 0 and 1, null outside."""

    def solve(q: Column) -> Column:
        step = lambda x, k: let(_upper(x), lambda u: F.least(x + (F.ln(u) - F.ln(q)) * u / _density(x), F.lit(37.5)))
        return fold(STEPS, F.lit(0.0), step)

    inner = let(F.least(p, 1 - p), lambda q: let(solve(q), lambda x: F.when(p < 0.5, -x).otherwise(x)))
    edge = F.when(p == 0, float("-inf")).when(p == 1, float("inf"))
    return F.when((p > 0) & (p < 1), inner).otherwise(edge)


def gamma_q(a: float, x: Column) -> Column:
    """The regularised upper incomplete gamma function of a > 0: a series below a + 1, a continued fraction above."""
    terms = int(100 + 12 * sqrt(a))

    def both(x: Column) -> Column:
        scale = F.exp(a * F.ln(x) - x - lgamma(a))
        series = fold(terms, F.lit(1.0), lambda s, k: 1 + s * x / (k + a)) / a
        fraction = fold(terms, x + (2 * terms + 1 - a), lambda s, k: x + 2 * k - 1 - a + k * (a - k) / s)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - scale * series).otherwise(scale / fraction)

    return let(x.cast("double"), both)


def chi2_sf(x: Column, df: int) -> Column:
    """P(chi-squared with df degrees of freedom > x)."""
    return gamma_q(df / 2, x / 2)


def two_sided_p(z: Column) -> Column:
    return 2 * normal_sf(F.abs(z))


def luck(trials: int) -> Column:
    """The largest of so many standard normals, expected: the bar for the best of so many trials, in standard deviations. None for one trial, which has no bar."""
    if trials <= 1:
        return F.lit(float("-inf"))
    return (1 - EULER) * normal_ppf(F.lit(1 - 1 / trials)) + EULER * normal_ppf(F.lit(1 - 1 / (trials * e)))


def sharpe_sd(sr: Column, skew: Column, kurtosis: Column, n: Column) -> Column:
    """Standard deviation of a Sharpe ratio over n days; kurtosis of a normal is 3."""
    return F.sqrt(F.greatest((1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) / (n - 1), F.lit(LEAST_VARIANCE)))
