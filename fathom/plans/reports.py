"""The four reports: audit, backtest, forecasts and portfolio. Tables stay DataFrames; a report's numbers are a few rows."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import two_sided_p
from ..operators import audit, backtest, features, forecast, inference, panel, portfolio
from ..operators.backtest import BASELINE
from ..operators.factors import NAMES, add_factors
from ..sources import files
from ..sources.store import written


@dataclass
class Report:
    """numbers: what goes to JSON; tables: DataFrames by name."""

    numbers: dict[str, Any]
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Home:
    """Where everything lies below one folder of any store that Spark writes: raw files, prices, and reports in versions.

    A report is written whole to a folder of its own; then one line is appended to its list of versions, which Spark
    commits at once or not at all. Readers follow the last line, so until then, and if a write fails, they get the
    version before.
    """

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def prices(self) -> str:
        return f"{self.root}/processed/prices"

    def versions(self, name: str) -> str:
        return f"{self.root}/reports/{name}/versions"

    def save(self, spark: SparkSession, name: str, report: Report) -> None:
        """numbers as one JSON text, tables as CSV."""
        version = f"{datetime.now(UTC):%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/reports/{name}/{version}"
        text = json.dumps(report.numbers, indent=2, ensure_ascii=False, default=str)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/numbers")
        for table, df in report.tables.items():
            files.save_csv(df, f"{folder}/{table}.csv")
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("append").text(self.versions(name))

    def current(self, spark: SparkSession, name: str) -> str | None:
        """The folder of a report's last version; None if there is no such report."""
        try:
            last = spark.read.text(self.versions(name)).agg(F.max("value").alias("v")).first().v
        except AnalysisException:
            return None
        return last and f"{self.root}/reports/{name}/{last}"

    def numbers(self, spark: SparkSession, name: str) -> dict:
        """A saved report's numbers; none if there is no such report."""
        folder = self.current(spark, name)
        return json.loads(spark.read.text(f"{folder}/numbers", wholetext=True).first().value) if folder else {}

    def table(self, spark: SparkSession, name: str, table: str) -> DataFrame | None:
        """A saved report's table, with the types that its texts suggest; None if there is no such table."""
        folder = self.current(spark, name)
        try:
            return spark.read.csv(f"{folder}/{table}.csv", header=True, inferSchema=True) if folder else None
        except AnalysisException:
            return None


def _one(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict() if row else {}


def ingest(spark: SparkSession, raw_dir: str) -> Report:
    prices, sources = files.build_dataset(spark, raw_dir)
    return Report({"built_at_utc": datetime.now(UTC).isoformat(), "files": sources, **_one(files.metadata(prices))}, {"prices": prices})


def run_audit(prices: DataFrame) -> Report:
    p = panel.to_panel(prices).persist()
    try:
        s = _one(audit.market_summary(p))
        spread = _one(audit.momentum_check(audit.momentum_spreads(p)))
        stocks = [r.asDict() for r in audit.stock_audit(p).withColumn("vr_p_value", two_sided_p(F.col("z"))).collect()]  # a row for each ticker
    finally:
        p.unpersist()
    ratio = s["median_vr_q5"]
    numbers = {
        "tickers": s["tickers"], "date_range": [s["first_date"], s["last_date"]], "trading_days": s["trading_days"],
        "median_traded_share": s["median_traded_share"], "illiquid_stocks_below_60pct": s["illiquid_stocks_below_60pct"],
        "variance_ratio": {
            "median_vr_q5": ratio, "stocks_rejecting_random_walk_5pct": s["stocks_rejecting_random_walk_5pct"], "share_vr_above_1": s["share_vr_above_1"],
            "reading": None if ratio is None else "returns trend" if ratio > 1 else "returns revert",
        },
        "autocorrelation_ljung_box_significant": s["autocorrelation_ljung_box_significant"], "momentum_spread_check": spread,
        "interpretation": "Returns can be forecast if many tickers reject the random walk and the momentum spread is positive with a t-statistic above 2; else a backtest has little to find.",
    }
    columns = "ticker string, days long, ann_vol double, traded_share double, variance_ratio_q5 double, ljung_box_p double, vr_p_value double"
    rows = [tuple(r[c.split()[0]] for c in columns.split(", ")) for r in stocks]
    return Report(numbers, {"stock_audit": prices.sparkSession.createDataFrame(rows, columns)})


SOLID = "Chance that the Sharpe ratio is real, given how many factors were tried; above 0.95 it is solid."
LUCKY = "How often the best of as many factors does as well by luck alone; below 0.05 the best one is likely real."


def run_backtest(prices: DataFrame, cost_bps: float = 100.0, rebalance_days: int = 5, top_quantile: float = 0.20, warmup: int = 130, seed: int = 7, replicates: int = 2000) -> Report:
    spark = prices.sparkSession
    p = panel.to_panel(prices).persist()
    net = written(spark, backtest.net_returns(p, [*NAMES, BASELINE], rebalance_days, top_quantile, cost_bps, warmup), "net")
    p.unpersist()
    active, factors = backtest.active(net), net.where(F.col("strategy") != BASELINE)
    perf, boot = written(spark, backtest.performance(net), "perf"), written(spark, inference.bootstrap(active, replicates, seed, list(NAMES)), "boot")
    check = written(spark, inference.reality_check(active, seed=seed + 99, names=list(NAMES)), "check")
    deflated = written(spark, inference.deflated_sharpe(factors, len(NAMES)), "deflated")
    ranked = inference.ranking(perf.where(F.col("strategy") != BASELINE))
    verdict = inference.gates(perf.where(F.col("strategy") != BASELINE), boot, check, deflated)
    by = {r.pop("strategy"): r for r in map(Row.asDict, perf.collect())}  # a row for each strategy
    for r in map(Row.asDict, boot.collect()):  # a row for each factor
        by[r.pop("strategy")]["active_vs_baseline"] = r
    ranking = [r.strategy for r in ranked.orderBy("place").select("strategy").collect()]  # a row for each factor
    passed = {r.gate: r.passed for r in verdict.collect()}  # a row for each gate
    solid = {k: v for k, v in _one(deflated.where(F.col("strategy") == ranking[0]).drop("strategy")).items() if v is not None}
    if len(solid) > 1:
        solid["interpretation"] = SOLID
    checked = _one(check)
    numbers = {
        "baseline_equal_weight": by.pop(BASELINE), "factors": by, "ranking": ranking, "best_factor": ranking[0], "reality_check": {**checked, "interpretation": LUCKY} if checked else {"skipped": True},
        "deflated_sharpe_best": solid, "deployment_gates": passed, "production_verdict": f"DEPLOYER {ranking[0]}" if all(passed.values()) else "RESTER SUR LE BASELINE: no factor passes every statistical gate.",
        "frictions": {"cost_bps_per_side": cost_bps, "rebalance_days": rebalance_days, "top_quantile": top_quantile},
    }
    daily = net.groupBy("date").pivot("strategy", [BASELINE, *NAMES]).agg(F.first("net")).orderBy("date")
    return Report(numbers, {"strategy_daily_returns": daily})


def run_alpha(prices: DataFrame, horizons: dict[str, int] | None = None, model: str = "ensemble") -> Report:
    """Forecasts of every horizon, each shrunk by its skill out of sample; a horizon with too short a history gets the market's mean."""
    spark, horizons = prices.sparkSession, horizons or features.HORIZONS
    p = panel.to_panel(prices).persist()
    rows = features.add_targets(features.add_features(p), horizons).persist()
    oos = table = None
    try:
        data = forecast.samples(rows, horizons)
        oos = forecast.walk_forward(data, model=model).persist()
        market = panel.market_series(p)
        table = forecast.horizon_table(oos, horizons, market).persist()
        by = {r.horizon: r for r in table.collect()}  # a row for each horizon
        skill = {k: {c: r[c] for c in ("ic", "t_stat", "n", "mode")} for k, r in by.items() if r.oos_samples}
        best = max((r["ic"] or 0.0 for r in skill.values()), default=0.0)
        now = forecast.latest(rows)
        raw = forecast.final_forecasts(data.where(F.col("horizon").isin(list(skill))), now, model)
        forecasts = forecast.blended(now, table, raw)
        top = forecast.top_ten(forecasts, now)
        tables = {"forecasts": written(spark, forecasts, "forecasts"), "top10": written(spark, top, "top10")}
        last = p.agg(F.max("date")).first()[0]
        numbers = {
            "as_of": last, "universe": now.count(), "market_regime": {k: v for k, v in _one(forecast.market_regime(market)).items() if v is not None},
            "horizons": {k: {"oos_samples": by[k].oos_samples, "skill": skill.get(k), "forecast_shrinkage": by[k].skill_weight} for k in horizons},
            "quarterly_top10_backtest": _one(forecast.quarterly(oos.where("horizon = '3M'"))), "top10_3m": [r.asDict() for r in tables["top10"].orderBy(F.desc("expected_return_pct"), "ticker").collect()],  # ten rows
            "honesty_note": f"A forecast is the market's mean plus the model's difference from it, weighted by the model's skill out of sample. The best information coefficient is {best:.3f}; without skill, forecasts stay at the market's mean.",
        }
    finally:
        for df in (p, rows, oos, table):
            if df is not None:
                df.unpersist()
    return Report(numbers, tables)


def build_portfolio(prices: DataFrame, capital: float = 100_000.0, verdict: dict | None = None, cost_bps: float = 100.0) -> Report:
    """Weights by risk parity of the eligible tickers, or of the best fifth by the best factor if a backtest's report (verdict) passed every gate."""
    spark = prices.sparkSession
    p = panel.to_panel(prices).persist()
    try:
        rows = backtest.eligibility(p)
        factor = verdict.get("best_factor") if verdict and all(verdict.get("deployment_gates", {"": False}).values()) else None
        scores = None
        if factor:
            f = add_factors(p, [factor])
            scores = f.where(F.col("d_idx") == f.agg(F.max("d_idx")).scalar()).select("ticker", F.col(factor).alias("score"))
        chosen = portfolio.selection(rows, scores)
        returns = portfolio.recent_returns(p).join(chosen.select("ticker"), "ticker", "left_semi")
        parity = written(spark, portfolio.hrp_weights(written(spark, returns.select(F.lit("p").alias("portfolio"), "ticker", "d_idx", "ret"), "returns")), "parity")
        known = parity.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("weight") | F.col("weight").isNull()).alias("bad")).first()
        weights = parity.select("ticker", "weight") if known.n and not known.bad else portfolio.inverse_volatility(p, chosen)
        table = written(spark, portfolio.sized(portfolio.capped(weights), p, capital), "positions")
        invested = table.agg(F.coalesce(F.sum("weight_pct"), F.lit(0.0)).alias("pct"), F.count(F.lit(1)).alias("n")).first()
        last = p.agg(F.max("date")).first()[0]
    finally:
        p.unpersist()
    numbers = {
        "as_of": last, "mode": f"factor:{factor}" if factor else "baseline_equal_weight (no factor passes the statistical gates)", "capital_mad": capital, "positions": invested.n,
        "invested_pct": invested.pct, "estimated_entry_cost_pct": cost_bps / 100.0,
        "note": "Weights follow risk, with 12 % of the capital and three days of median volume at most for each position. The baseline holds the liquid market at the least cost, as no signal is proven.",
    }
    return Report(numbers, {"current_portfolio": table})
