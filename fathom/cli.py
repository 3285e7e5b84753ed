"""Command line: python -m fathom.cli COMMAND --home FOLDER. Raw files are read from FOLDER/raw, prices and reports are written below FOLDER."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import reports
from .sources import files, synthetic


# Names of commands and options, and their defaults.
def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="fathom")
    parser.add_argument("--home", default="data")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest")
    demo = sub.add_parser("demo")
    for name, default in (("--stocks", 40), ("--days", 500), ("--seed", 7)):
        demo.add_argument(name, type=int, default=default)
    sub.add_parser("audit")
    sub.add_parser("alpha")
    for name in ("backtest", "all"):
        sub.add_parser(name)
    back = sub.choices["backtest"]
    back.add_argument("--rebalance-days", type=int, default=5)
    back.add_argument("--top-quantile", type=float, default=0.20)
    for name in ("backtest", "all"):
        sub.choices[name].add_argument("--cost-bps", type=float, default=100.0)
    for p in (sub.add_parser("portfolio"), sub.choices["all"]):
        p.add_argument("--capital", type=float, default=100_000.0)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs a command and returns the numbers of the reports it made, by name."""
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fathom").getOrCreate()
    home, out = reports.Home(a.home), {}
    stored = home.prices

    def done(name: str, report: reports.Report) -> dict:
        home.save(spark, name, report)
        out[name] = report.numbers
        return report.numbers

    if a.command in ("ingest", "all"):
        got = reports.ingest(spark, home.raw)
        got.tables.pop("prices").write.mode("overwrite").parquet(stored)
        done("ingest_metadata", got)
    elif a.command == "demo":
        synthetic.generate(spark, a.stocks, a.days, a.seed).write.mode("overwrite").parquet(stored)
        n = files.load_prices(spark, stored).count()
        done("ingest_metadata", reports.Report({"mode": "synthetic", "tickers": a.stocks, "rows": n}))
    if a.command in ("audit", "all"):
        done("market_audit", reports.run_audit(files.load_prices(spark, stored)))
    if a.command == "backtest":
        done("factor_backtest", reports.run_backtest(files.load_prices(spark, stored), a.cost_bps, a.rebalance_days, a.top_quantile))
    elif a.command == "all":
        done("factor_backtest", reports.run_backtest(files.load_prices(spark, stored), a.cost_bps))
    if a.command in ("alpha", "all"):
        done("alpha_report", reports.run_alpha(files.load_prices(spark, stored)))
    if a.command in ("portfolio", "all"):
        verdict = out.get("factor_backtest") or home.numbers(spark, "factor_backtest")
        done("portfolio_report", reports.build_portfolio(files.load_prices(spark, stored), a.capital, verdict))
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return out


if __name__ == "__main__":
    main()
