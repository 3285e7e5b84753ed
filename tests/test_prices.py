"""Cleaning, price files, invented prices, statistics and reports."""

from __future__ import annotations

import json
import zipfile
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom import cli
from fathom.functions.parsing import normalize_label, parse_date, parse_number
from fathom.operators import audit, backtest, features, panel, portfolio
from fathom.operators.forecast import skill_weight
from fathom.plans import reports
from fathom.sources import datasource, files, synthetic
from fathom.sources.spreadsheets import read_book


def book(path, tables: dict[str, list[list]]) -> None:
    """A small workbook with numbers and inline texts."""
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(tables)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(tables))) + "</Relationships>")
        for i, rows in enumerate(tables.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", "<worksheet><sheetData>" + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")


def test_numbers_and_dates(spark):
    texts = ["512,00", "1 200", "1 234,56", "1.234,56", "-", "nd", "", None, "1.0d", "-3e2", "inf"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_number(F.col("t"))).collect()]
    assert got == [512.0, 1200.0, 1234.56, None, None, None, None, None, None, -300.0, None]
    dates = ["02/01/2025", "2025-01-03", "6/1/2025", "what", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in dates], "t string").select(parse_date(F.col("t"))).collect()]
    assert got == [date(2025, 1, 2), date(2025, 1, 3), date(2025, 1, 6), None, None]
    assert normalize_label("  Cours_de  Clôture ") == "cours de cloture"


def test_build_dataset(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        files.build_dataset(spark, str(tmp_path / "none"))
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a_long.csv").write_text("Date de cotation;Libellé;Cours de clôture;Nombre de titres\n02/01/2025;attijari ;512,00;1 200\n03/01/2025;ATTIJARI;515,50;900\n")
    (raw / "b_late.csv").write_text("date,ticker,close\n03/01/2025,ATTIJARI,600\n03/01/2025,ZERO,0\n")
    (raw / "IAM.txt").write_text("séance;clôture\n02/01/2025;101,5\n")
    (raw / "notes.txt").write_text("nothing here\n")
    book(raw / "wide.xlsx", {"w": [["Date", "IAM", "BCP"], ["02/01/2025", "101,5", 270], ["03/01/2025", "102,0", "272"], ["06/01/2025", "101,0", "271"]]})
    prices, told = files.build_dataset(spark, str(raw))
    got = {(str(r.date), r.ticker): (r.close, r.volume) for r in prices.collect()}
    assert got[("2025-01-02", "ATTIJARI")] == (512.0, 1200.0)
    assert got[("2025-01-03", "ATTIJARI")] == (600.0, None)  # the later file counts
    (raw / "IAM été + 50%.csv").write_text('"date, de cotation";"clôture"\n02/01/2025;7\n')
    assert {r.ticker for r in files.build_dataset(spark, str(raw))[0].collect()} == {"ATTIJARI", "IAM", "BCP", "IAM ÉTÉ + 50%"}
    assert len(got) == 2 + 3 + 3 and ("2025-01-03", "ZERO") not in got
    assert sum("OK (long)" == t["status"] for t in told) == 3 and sum("OK (wide)" == t["status"] for t in told) == 1
    assert [n for n, _ in read_book((raw / "wide.xlsx").read_bytes())] == ["w"]
    book(raw / "z.xlsx", {"long": [["Séance", "Valeur", "Cours", "Titres échangés"], ["06/01/2025", "bcp", "272,5", 10]], "bare": [["a"], ["b"]], "few dates": [["Date", "X", "Y"], ["no", 1, 2], ["nor this", 1, 2], ["07/01/2025", 1, 2]]})
    (raw / "deep").mkdir()
    (raw / "deep" / "quoted.csv").write_text('"Valeur, nom","jour","Dernier, cours","quantité"\n"x, y","2025-01-07","1 234,5","3"\nIAM,2025-01-08,99\n')
    by_source = sorted(map(tuple, datasource.read_prices(spark, str(raw)).collect()), key=repr)
    assert by_source == sorted(map(tuple, files.build_dataset(spark, str(raw))[0].collect()), key=repr)
    cells = {(str(r.date), r.ticker): (r.close, r.volume) for r in datasource.read_prices(spark, str(raw)).collect()}
    assert cells["2025-01-06", "BCP"] == (272.5, 10.0) and cells["2025-01-07", "X, Y"] == (1234.5, 3.0) and cells["2025-01-08", "IAM"] == (99.0, None)
    assert not {"X", "Y"} & {t for _, t in cells}
    tables = datasource.raw_tables(spark, str(raw))
    assert tables.columns == ["_src", "_kind", "_row", "date", "ticker", "close", "volume"]
    assert tables.rdd.getNumPartitions() == len({r._src for r in tables.select("_src").distinct().collect()})
    with pytest.raises(FileNotFoundError):
        datasource.read_prices(spark, str(tmp_path / "none"))


def test_reports_in_versions(spark, tmp_path):
    """Until a version is whole, and if a write fails, readers get the one before."""
    home = reports.Home(str(tmp_path / "home"))
    assert home.numbers(spark, "r") == {} and home.table(spark, "r", "t") is None
    table = lambda x: spark.createDataFrame([(x,)], "x long")
    home.save(spark, "r", reports.Report({"n": 1, "é": None}, {"t": table(1)}))
    first = home.current(spark, "r")
    broken = spark.range(1).select(F.raise_error(F.concat(F.lit("no"), F.col("id").cast("string"))).cast("string").alias("x"))
    with pytest.raises(Exception, match="no0"):
        home.save(spark, "r", reports.Report({"n": 2}, {"t": table(2), "u": broken}))
    assert home.current(spark, "r") == first and home.numbers(spark, "r") == {"n": 1, "é": None}
    held = home.table(spark, "r", "t")
    home.save(spark, "r", reports.Report({"n": 3}, {"t": table(3)}))
    assert home.numbers(spark, "r") == {"n": 3} and home.table(spark, "r", "t").first().x == 3
    assert held.first().x == 1  # who reads the version before still can
    home.save(spark, "other", reports.Report({}))
    assert home.numbers(spark, "other") == {} and home.table(spark, "other", "t") is None and home.current(spark, "other")


def test_synthetic_factors_and_costs(spark):
    prices = synthetic.generate(spark, 20, 320, 3).persist()
    assert prices.count() == 6400 and prices.exceptAll(synthetic.generate(spark, 20, 320, 3)).count() == 0
    p = panel.to_panel(prices)
    net = {bps: backtest.performance(backtest.net_returns(p, ["reversal_5d"], cost_bps=bps)).where("strategy = 'reversal_5d'").first().ann_return for bps in (0.0, 100.0)}
    assert net[0.0] > net[100.0]
    report = reports.run_backtest(prices, replicates=200)
    assert len(report.numbers["ranking"]) == 10 and set(report.numbers["deployment_gates"].values()) <= {True, False}
    assert 0 < report.numbers["reality_check"]["p_value"] <= 1


def test_whole_command_line(spark, tmp_path, monkeypatch):
    """ingest, audit, backtest, alpha and portfolio on one folder, each report with its keys."""
    home, raw = str(tmp_path), tmp_path / "raw"
    raw.mkdir()
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2022-01-03", periods=330)
    for k in range(3):
        frame = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0.0004, 0.012, (330, 4)), axis=0)), columns=[f"T{k}{i}" for i in range(4)])
        frame.insert(0, "Date", days.strftime("%d/%m/%Y"))
        frame.to_csv(raw / f"wide{k}.csv", sep=";", index=False)
    assert cli.main(["--home", home, "ingest"], spark)["ingest_metadata"]["tickers"] == 12
    whole, short = reports.run_backtest, reports.run_alpha
    monkeypatch.setattr(reports, "run_backtest", lambda *a: whole(*a, replicates=200))
    monkeypatch.setattr(reports, "run_alpha", lambda prices: short(prices, {"1M": 21}, "ridge"))
    back = cli.main(["--home", home, "backtest", "--rebalance-days", "10", "--top-quantile", "0.3"], spark)["factor_backtest"]
    assert back["frictions"] == {"cost_bps_per_side": 100.0, "rebalance_days": 10, "top_quantile": 0.3}
    assert set(back["factors"][back["best_factor"]]["active_vs_baseline"]) == {"mean_ann", "ci05", "ci95", "p_le_0"}
    alpha = cli.main(["--home", home, "alpha"], spark)["alpha_report"]
    assert {"as_of", "universe", "horizons", "market_regime", "quarterly_top10_backtest", "top10_3m", "honesty_note"} <= set(alpha)
    got = cli.main(["--home", home, "all", "--cost-bps", "50", "--capital", "5000"], spark)
    assert set(got) == {"ingest_metadata", "market_audit", "factor_backtest", "alpha_report", "portfolio_report"}
    assert got["portfolio_report"]["capital_mad"] == 5000 and "interpretation" in got["market_audit"]


def test_stream_keeps_to_its_table_and_zone(spark, tmp_path):
    from fathom.streaming.bars import bars_once, daily_bars

    rows = [("a", f"2025-01-0{1 + i % 3} 23:30:00", float(i)) for i in range(30)] + [("a", None, 1.0), ("b", "2025-01-01 00:00:00", None)]
    events = spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    events.write.parquet(str(tmp_path / "events.parquet.old"))
    want = sorted(map(tuple, daily_bars(events).collect()))
    assert sorted(map(tuple, bars_once(spark, str(tmp_path / "events.parquet")).collect())) == want and len(want) == 3
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Africa/Casablanca")
        assert sorted(map(tuple, bars_once(spark, str(tmp_path / "events.parquet")).collect())) == sorted(map(tuple, daily_bars(events).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_no_look_ahead(spark):
    prices = synthetic.generate(spark, 6, 200, 12)
    cut = prices.where(F.col("date") <= F.lit(pd.bdate_range("2024-07-01", periods=200)[150].date()))
    at = pd.bdate_range("2024-07-01", periods=200)[120].date()
    one = lambda df: features.add_features(panel.to_panel(df)).where(F.col("date") == F.lit(at)).select("ticker", *features.FEATURES).orderBy("ticker").toPandas()
    pd.testing.assert_frame_equal(one(prices), one(cut), atol=1e-10)
    ahead = features.add_targets(panel.to_panel(prices), {"1M": 21}).where("ticker = 'CSE01'").orderBy("d_idx").toPandas()
    assert np.isclose(ahead.fwd_21[50], np.log(ahead.close[71] / ahead.close[50]))


def test_statistics(spark):
    rng = np.random.default_rng(1)
    noise, trend = rng.normal(0, 0.01, 2000), np.zeros(1500)
    for t in range(1, 1500):
        trend[t] = 0.35 * trend[t - 1] + rng.normal(0, 0.01)
    rows = [("N", i, float(x)) for i, x in enumerate(noise)] + [("T", i, float(x)) for i, x in enumerate(trend)]
    p = spark.createDataFrame(rows, "ticker string, d_idx long, ret double")
    vr = {r.ticker: r for r in audit.variance_ratio(p).collect()}
    lb = {r.ticker: r for r in audit.ljung_box(p).collect()}
    assert 0.9 < vr["N"].vr < 1.1 < vr["T"].vr
    assert lb["N"].p_value > 0.01 and lb["T"].p_value < 0.001
    matrix = [("p", f"S{j}", i, float(x)) for i, row in enumerate(rng.normal(0, 0.01, (200, 8))) for j, x in enumerate(row)]
    w = portfolio.hrp_weights(spark.createDataFrame(matrix, "portfolio string, ticker string, d_idx long, ret double")).toPandas().weight
    assert len(w) == 8 and abs(w.sum() - 1) < 1e-9 and w.min() > 0
    got = spark.createDataFrame([(-0.2,), (0.0,), (0.05,)], "ic double").select(skill_weight(F.col("ic"))).collect()
    assert [r[0] for r in got] == [0.0, 0.0, 0.25]


def test_command_line(spark, tmp_path):
    home = str(tmp_path)
    cli.main(["--home", home, "demo", "--stocks", "12", "--days", "260"], spark)
    got = cli.main(["--home", home, "audit"], spark)
    assert got["market_audit"]["tickers"] == 12
    got = cli.main(["--home", home, "portfolio"], spark)["portfolio_report"]
    assert got["mode"].startswith("baseline_equal_weight") and 0 < got["invested_pct"] <= 100 and got["note"]
    store = reports.Home(home)
    table = store.table(spark, "portfolio_report", "current_portfolio").toPandas()
    assert got["invested_pct"] == pytest.approx(table.weight_pct.sum()) and got["estimated_entry_cost_pct"] == 1.0
    assert store.table(spark, "portfolio_report", "none") is None and store.table(spark, "none", "none") is None
    assert store.numbers(spark, "portfolio_report")["positions"] == got["positions"]
    assert store.numbers(spark, "none") == {} and json.dumps(got, default=str)
    alpha = reports.run_alpha(files.load_prices(spark, f"{home}/processed/prices"), {"1M": 21, "3M": 63}, "ridge")
    assert alpha.tables["forecasts"].count() == 24
