"""Invented prices with known structure, for demonstrations and tests: each ticker is made by its own task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Those in returns_of() and prices_of(), which give the invented market its known structure, and this limit of a day's move.
LIMIT = 0.06


def returns_of(rng: np.random.Generator, market: np.ndarray) -> np.ndarray:
    """Daily log returns: the market times a beta, noise, a drift that falls with volatility, and a pull towards the mean of the last 60 days."""
    beta, vol = rng.uniform(0.4, 1.4), rng.uniform(0.008, 0.028)
    own = 0.0004 - 0.008 * vol + beta * market + rng.normal(0, vol, len(market))
    out = np.zeros(len(market))
    sums = np.zeros(len(market) + 1)
    for t, x in enumerate(own):
        first = max(0, t - 60)
        pull = 0.06 * (sums[t] - sums[first]) / (t - first) if t > 10 else 0.0
        out[t] = min(max(x + pull, -LIMIT), LIMIT)
        sums[t + 1] = sums[t] + out[t]
    return out


def prices_of(i: int, days: int, seed: int) -> pd.DataFrame:
    """Prices of one ticker: on stale days the last price stands and nothing is traded."""
    market = np.random.default_rng(seed).normal(0.0003, 0.007, days)  # the same for all
    rng = np.random.default_rng([seed, i])
    path = 100 * np.exp(np.cumsum(returns_of(rng, market)))
    stale = rng.random(days) < rng.uniform(0.05, 0.45)
    stale[:1] = False
    close = path[np.maximum.accumulate(np.where(stale, 0, np.arange(days)))]
    volume = np.where(stale, 0.0, rng.uniform(2e3, 8e4) * np.exp(rng.normal(0, 0.8, days)))
    return pd.DataFrame({"date": pd.bdate_range("2024-07-01", periods=days).date, "ticker": f"CSE{i:02d}", "close": close.round(2), "volume": volume.round(0)})


def generate(spark: SparkSession, stocks: int = 40, days: int = 500, seed: int = 7) -> DataFrame:
    """(date, ticker, close, volume) of so many tickers and business days; equal arguments give equal tables."""

    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                yield prices_of(int(i), days, seed)

    ids = spark.range(1, stocks + 1).select(F.col("id"))
    return ids.mapInPandas(run, "date date, ticker string, close double, volume double")
