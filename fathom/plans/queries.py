"""The registered queries: each runs an operator over whole tables. Doubles are rounded at the end only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import DATE_FORMATS, normalize_ticker, parse_date, parse_number
from ..operators import audit, backtest, dashboard, features, forecast, inference, portfolio
from ..operators import panel as panels
from ..operators.backtest import BASELINE
from ..operators.factors import NAMES, add_factors, long_scores, zscore
from ..sources.adapter import sales_prices
from ..sources.datasource import read_prices
from ..sources.files import build_dataset
from ..sources.store import shared_path, written
from . import oracle as o
from .oracle import luck_in_numbers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def panel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel over the sales tables, which are read once: prices (tickers by dates) are written, as calendar, tickers and closes each need them."""
    return panels.to_panel(written(spark, sales_prices(spark, sf_dir), "prices"), unique=True)


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, and no negative zero."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- panel


@register("panel_dense", o.q("select ticker, date, d_idx, round(raw_close, 6) + 0.0::double raw_close, volume from grid"))
def panel_dense(spark, sf_dir):
    return r6(panels.dense(written(spark, sales_prices(spark, sf_dir), "prices")))


@register("panel_ffill", o.q("select ticker, date, round(close, 6) + 0.0::double as close, volume from panel"))
def panel_ffill(spark, sf_dir):
    return r6(panel_of(spark, sf_dir).select("ticker", "date", "close", "volume"))


@register("log_returns", o.q("select ticker, date, round(ret, 6) + 0.0::double ret from panel where ret is not null"))
def log_returns(spark, sf_dir):
    return r6(panel_of(spark, sf_dir).where("ret is not null").select("ticker", "date", "ret"))


@register("traded_flag", o.q("select ticker, count(*) as days, count(*) filter (traded) traded_days from panel group by ticker"))
def traded_flag(spark, sf_dir):
    return panel_of(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.count_if("traded").alias("traded_days"))


@register("calendar_ordinal", o.q("select date, d_idx from cal"))
def calendar_ordinal(spark, sf_dir):
    return panels.calendar(sales_prices(spark, sf_dir))


@register("price_metadata", o.q("select count(distinct ticker) tickers, count(*) as rows, min(date) first_date, max(date) last_date from prices"))
def price_metadata(spark, sf_dir):
    from ..sources.files import metadata

    return metadata(sales_prices(spark, sf_dir))


# ---------------------------------------------------------------- cleaning and reshaping


def _raw(spark, sf_dir):
    """Order totals as the texts of a price file: thousands with spaces, decimal commas, and marks of missing values."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    text = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(" "), F.lpad((F.floor("o_totalprice") % 1000).cast("string"), 3, "0"), F.lit(",5"))
    value = F.when(k % 7 == 0, "n/d").when(k % 7 == 1, "-").when(k % 7 == 2, F.concat(F.lit(" "), k.cast("string"), F.lit(".25"))).when(k % 7 == 3, "1.234,56").otherwise(text)
    # a text in each of the formats, some null and some that are no dates
    day = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("n/d"))
    for i, f in enumerate(DATE_FORMATS):
        day = day.when(k % len(DATE_FORMATS) == i, F.concat(F.lit(" "), F.date_format("o_orderdate", f)))
    return orders.select("o_orderkey", value.alias("value"), day.alias("day"), F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")).alias("name"))


_RAW = """with raw as (select o_orderkey, case o_orderkey % 7 when 0 then 'n/d' when 1 then '-' when 2 then ' ' || o_orderkey || '.25' when 3 then '1.234,56' else floor(o_totalprice / 1000)::bigint || ' ' || lpad((floor(o_totalprice)::bigint % 1000)::varchar, 3, '0') || ',5' end as value, strftime(o_orderdate, '%d/%m/%Y') as day, '  ' || lower(o_orderpriority) || ' ' as name from orders)
"""


@register("parse_number", _RAW + "select o_orderkey, case when replace(replace(value, ' ', ''), ',', '.') in ('', '-', '--', 'nd', 'n/d', 'na') then null else try_cast(replace(replace(value, ' ', ''), ',', '.') as double) end number from raw")
def parse_numbers(spark, sf_dir):
    return _raw(spark, sf_dir).select("o_orderkey", parse_number(F.col("value")).alias("number"))


@register("parse_date", "select o_orderkey, case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null else o_orderdate::date end as date from orders")
def parse_dates(spark, sf_dir):
    return _raw(spark, sf_dir).select("o_orderkey", parse_date(F.col("day")).alias("date"))


@register("normalize_ticker", "select upper(o_orderpriority) ticker, count(*) n from orders group by 1")
def normalize_tickers(spark, sf_dir):
    return _raw(spark, sf_dir).groupBy(normalize_ticker(F.col("name")).alias("ticker")).agg(F.count(F.lit(1)).alias("n"))


@register("valid_rows", "select c_mktsegment ticker, count(*) n, round(sum(c_acctbal), 4) + 0.0::double total from customer where c_acctbal > 0 and c_custkey % 5 <> 0 group by 1")
def valid_rows(spark, sf_dir):
    from ..sources.files import valid

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("ticker"), F.when(F.col("c_custkey") % 5 != 0, F.current_date()).alias("date"), F.col("c_acctbal").alias("close"))
    return valid(c).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


@register("dedupe_keep_last", "select o_custkey, cast(date_trunc('month', o_orderdate) as date) as month, max(o_orderkey) last_order from orders group by 1, 2")
def dedupe_keep_last(spark, sf_dir):
    from ..sources.files import keep_last

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("ticker"), F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.lit(0).alias("_src"), F.col("o_orderkey").alias("_row"), F.col("o_orderkey").alias("last_order"))
    return keep_last(rows).select(F.col("ticker").alias("o_custkey"), F.col("date").alias("month"), "last_order")


_MONTHS = "cast(date_trunc('month', date) as date)"


def _unpivoted(spark, sf_dir) -> DataFrame:
    """Each month's highest close of all tickers, made wide (a column for each ticker) and long again."""
    from ..sources.files import melt

    p = sales_prices(spark, sf_dir).withColumn("date", F.date_trunc("month", "date").cast("date"))
    tickers = sorted(r.ticker for r in p.select("ticker").distinct().collect())  # a row for each ticker
    if not tickers:
        return p.select("date", "ticker", "close")
    wide = p.groupBy("date").pivot("ticker", tickers).agg(F.max("close"))
    return melt(wide, "date", tickers).where("close is not null").select("date", "ticker", "close")


@register("unpivot_wide", o.q(f"select {_MONTHS} as date, ticker, max(close) as close from prices group by 1, 2"))
def unpivot_wide(spark, sf_dir):
    return _unpivoted(spark, sf_dir)


@register("union_missing_cols", "select 'c' src, c_custkey::bigint k, c_acctbal bal, null::varchar as name from customer union all select 's', s_suppkey::bigint, null, s_name from supplier")
def union_missing_cols(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("c").alias("src"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("s").alias("src"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


# ---------------------------------------------------------------- factors and cross-sections


def _factor(name: str):
    @register(f"fac_{name}", o.q(f"select ticker, date, round({name}, 6) + 0.0::double {name} from factors where {name} is not null", o.FACTORS_CTE))
    def run(spark, sf_dir):
        return r6(add_factors(panel_of(spark, sf_dir), [name]).where(F.col(name).isNotNull()).select("ticker", "date", name))


for _name in NAMES:
    _factor(_name)


@register("zscore_xs", o.q("select ticker, date, round(z, 6) + 0.0::double z from (select ticker, date, (momentum_126_21 - avg(momentum_126_21) over w) / nullif(stddev_samp(momentum_126_21) over w, 0) z from factors window w as (partition by date)) where z is not null", o.FACTORS_CTE))
def zscore_xs(spark, sf_dir):
    f = add_factors(panel_of(spark, sf_dir), ["momentum_126_21"])
    return r6(f.select("ticker", "date", zscore("momentum_126_21").alias("z")).where("z is not null"))


@register("avg_rank_pct", o.q(f"select ticker, date, round(({o.rank_sql('high_52w', 'date')}) / count(*) over (partition by date), 6) + 0.0::double pct from factors where high_52w is not null", o.FACTORS_CTE))
def avg_rank_pct(spark, sf_dir):
    from pyspark.sql import Window

    f = add_factors(panel_of(spark, sf_dir), ["high_52w"]).where("high_52w is not null")
    return r6(f.select("ticker", "date", (features.average_rank("high_52w", "date") / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("pct")))


@register("topk_by_date", o.q("select date, ticker, k from (select date, ticker, row_number() over (partition by date order by momentum_126_21 desc, ticker) k from factors where momentum_126_21 is not null) where k <= 5", o.FACTORS_CTE))
def topk_by_date(spark, sf_dir):
    from pyspark.sql import Window

    f = add_factors(panel_of(spark, sf_dir), ["momentum_126_21"]).where("momentum_126_21 is not null")
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("momentum_126_21"), "ticker"))
    return f.select("date", "ticker", k.alias("k")).where("k <= 5")


# ---------------------------------------------------------------- backtest


@register("eligibility", o.q("select ticker, date, round(traded_share, 6) + 0.0::double traded_share, round(money_volume, 4) + 0.0::double money_volume, eligible from elig", o.ELIGIBLE_CTE))
def eligibility(spark, sf_dir):
    e = backtest.eligibility(panel_of(spark, sf_dir))
    return e.select("ticker", "date", F.round("traded_share", 6).alias("traded_share"), F.round("money_volume", 4).alias("money_volume"), "eligible")


def net_of(spark: SparkSession, panel: DataFrame, names: list[str], warmup: int = 130) -> DataFrame:
    """Net returns over a panel that is written first: scores, returns and the calendar each read it."""
    return backtest.net_returns(written(spark, panel, "panel"), names, warmup=warmup)


@register("weights_momentum", o.q("select date, ticker, round(weight, 6) + 0.0::double weight from weights join cal using (d_idx)", o.FACTORS_CTE, o.ELIGIBLE_CTE, o.scores_cte(["momentum_126_21"]), o.NET_CTE))
def weights_momentum(spark, sf_dir):
    _, goals, days = backtest.strategies(panel_of(spark, sf_dir), ["momentum_126_21"])
    return r6(backtest.held(goals, days).join(F.broadcast(days), "d_idx").select("date", "ticker", "weight"))  # bounded: a trading calendar


@register("weights_baseline", o.q("select date, ticker, round(weight, 6) + 0.0::double weight from weights join cal using (d_idx)", o.ELIGIBLE_CTE, o.scores_cte([BASELINE]), o.NET_CTE))
def weights_baseline(spark, sf_dir):
    _, goals, days = backtest.strategies(panel_of(spark, sf_dir), [BASELINE])
    return r6(backtest.held(goals, days).join(F.broadcast(days), "d_idx").select("date", "ticker", "weight"))  # bounded: a trading calendar


_ALL = [*NAMES, BASELINE]
_BT = (o.FACTORS_CTE, o.ELIGIBLE_CTE, o.scores_cte(_ALL), o.NET_CTE)


@register("net_returns", o.q("select strategy, date, round(gross, 6) + 0.0::double gross, round(net, 6) + 0.0::double net from net", *_BT))
def net_returns(spark, sf_dir):
    return r6(net_of(spark, panel_of(spark, sf_dir), _ALL).select("strategy", "date", "gross", "net"))


@register("turnover", o.q("select strategy, round(avg(turnover), 6) + 0.0::double avg_daily_turnover from net group by 1", *_BT))
def turnover(spark, sf_dir):
    return r6(net_of(spark, panel_of(spark, sf_dir), _ALL).groupBy("strategy").agg(F.avg("turnover").alias("avg_daily_turnover")))


_PERF = ["ann_return", "ann_vol", "sharpe", "max_drawdown", "hit_rate", "avg_daily_turnover"]


@register("performance_table", o.q(f"select strategy, days, {o.rounded(_PERF)} from perf", *_BT, o.PERF_CTE))
def performance_table(spark, sf_dir):
    return r6(backtest.performance(net_of(spark, panel_of(spark, sf_dir), _ALL)).select("strategy", "days", *_PERF))


@register("drawdown_curve", o.q("select strategy, date, round(equity, 6) + 0.0::double equity, round(drawdown, 6) + 0.0::double drawdown from dd", *_BT, o.PERF_CTE))
def drawdown_curve(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("strategy").orderBy("d_idx").rowsBetween(Window.unboundedPreceding, 0)
    net = net_of(spark, panel_of(spark, sf_dir), _ALL).withColumn("equity", F.sum("net").over(w))
    return r6(net.select("strategy", "date", "equity", (F.col("equity") - F.max("equity").over(w)).alias("drawdown")))


@register("equity_moments", o.q("select strategy, count(net) n, round(avg(net) / stddev_samp(net), 6) + 0.0::double sr, round(sum((net - m) ** 3) / count(*) / (sum((net - m) ** 2) / count(*)) ** 1.5, 6) + 0.0::double skew, round(sum((net - m) ** 4) / count(*) / (sum((net - m) ** 2) / count(*)) ** 2, 5) + 0.0::double kurtosis from (select *, avg(net) over (partition by strategy) m from net) group by strategy", *_BT))
def equity_moments(spark, sf_dir):
    m = inference.moments(net_of(spark, panel_of(spark, sf_dir), _ALL))
    return m.select("strategy", "n", (F.round("sr", 6) + F.lit(0.0)).alias("sr"), (F.round("skew", 6) + F.lit(0.0)).alias("skew"), F.round("kurtosis", 5).alias("kurtosis"))


_ACTIVE = "active as (select a.strategy, a.d_idx, a.net - b.net x from net a join net b on b.strategy = 'baseline_equal_weight' and a.d_idx = b.d_idx where a.strategy <> 'baseline_equal_weight')"
_BT3 = (*_BT, _ACTIVE)


def _draw(rep: str, i: str, n: str, seed: int) -> str:
    x = f"(({rep}) * 7919 + ({i}) * 104729 + {seed} * 611953) % 2147483647"
    return f"((((({x}) * 48271) % 2147483647) * 69621) % 2147483647) % {n}"


_BOOT_CTES = (
    "bat_ as (select strategy, x, row_number() over (partition by strategy order by d_idx) - 1 k, count(*) over (partition by strategy) n, avg(x) over (partition by strategy) m from active)",
    f"bdraws as (select strategy, rep, {_draw('rep', 'k', 'n', 7)} k from bat_, (select unnest(range(2000)) rep))",
)
_BOOT = """select strategy, any_value(m) mean_ann, quantile_cont(mean, 0.05) ci05, quantile_cont(mean, 0.95) ci95, avg((mean <= 0)::int::double) p_le_0
from (select d.strategy, d.rep, avg(t.x) * 252 mean, any_value(t.m) * 252 m from bdraws d join bat_ t on t.strategy = d.strategy and t.k = d.k group by d.strategy, d.rep) group by strategy"""


def _reality_ctes(replicates: int) -> list[str]:
    return [
        "at_ as (select a.strategy, a.x, k.k from active a join (select d_idx, row_number() over (order by d_idx) - 1 k from (select distinct d_idx from active)) k using (d_idx))",
        "nn as (select count(distinct k) n from at_)",
        f"draws as (select rep, n, (({_draw('rep', 'i // 10 + (n + 9) // 10', 'n', 106)}) + i % 10) % n k from nn, (select unnest(range({replicates})) rep), (select distinct k i from at_))",
    ]


def _reality_sql(replicates: int, *ctes: str) -> str:
    return o.q("""select rep, round(max(m - m0) * sqrt(any_value(n)), 6) + 0.0::double stat from (select d.rep, x.strategy, avg(x.x) m, any_value(n) n from draws d join at_ x on x.k = d.k group by 1, 2) join (select strategy, avg(x) m0 from at_ group by 1) using (strategy) group by rep""", *ctes, *_reality_ctes(replicates))


_MEANS = "select strategy, avg(x) m0 from at_ group by 1"
_REALITY_P = """select any_value(best) * sqrt(any_value(n)) statistic, (count(*) filter (stat >= best * sqrt(n)) + 1) / (count(*) + 1) p_value, any_value(best_factor) best_factor, any_value(family)::bigint factors_in_family
from (select rep, max(m - m0) * sqrt(any_value(n)) stat, any_value(n) n from (select d.rep, x.strategy, avg(x.x) m, any_value(n) n from draws d join at_ x on x.k = d.k group by 1, 2) join means using (strategy) group by rep), (select max(m0) best, first(strategy order by m0 desc, strategy) best_factor, count(*) family from means)"""


@register("bootstrap_iid", o.q(f"select strategy, {o.rounded(['mean_ann', 'ci05', 'ci95', 'p_le_0'])} from boot", *_BT3, *_BOOT_CTES, f"boot as ({_BOOT})"))
def bootstrap_iid(spark, sf_dir):
    return r6(inference.bootstrap(backtest.active(net_of(spark, panel_of(spark, sf_dir), _ALL)), 2000, names=list(NAMES)))


@register("reality_check", _reality_sql(1000, *_BT3))
def reality_check(spark, sf_dir):
    """The family's largest mean in each of the replicates, from which the p-value is counted."""
    rows = inference.filled(backtest.active(net_of(spark, panel_of(spark, sf_dir), _ALL)))
    return r6(inference.family_maxima(rows, 1000, names=list(NAMES)))


@register("reality_check_p_value", o.q(f"select {o.rounded(['statistic', 'p_value'])}, best_factor, factors_in_family from rcheck", *_BT3, *_reality_ctes(1000), f"means as ({_MEANS})", f"rcheck as ({_REALITY_P})"))
def reality_check_p_value(spark, sf_dir):
    return r6(inference.reality_check(backtest.active(net_of(spark, panel_of(spark, sf_dir), _ALL)), names=list(NAMES)))


_MOMENTS = """mo as (select strategy, count(net) n, case when any_value(sd) > 0 then any_value(m) / any_value(sd) end sr, sum((net - m) ** 3) / count(*) / (sum((net - m) ** 2) / count(*)) ** 1.5 skew, sum((net - m) ** 4) / count(*) / (sum((net - m) ** 2) / count(*)) ** 2 kurt
 from (select *, avg(net) over (partition by strategy) m, stddev_samp(net) over (partition by strategy) sd from net) where strategy <> 'baseline_equal_weight' group by strategy)"""
_DSR = (_MOMENTS, f"""ds as (select *, sqrt(greatest((1 - skew * sr + (kurt - 1) / 4 * sr ** 2) / (n - 1), 1e-12)) sd from mo),
dz as (select *, sd * {luck_in_numbers(len(NAMES))!r}::double bar from ds),
dsr as (select strategy, n, sr, bar, coalesce(case when n >= 60 and sr is not null then {o.normal_cdf('((sr - bar) / sd)')} end, 0) dsr from dz)""")


@register("deflated_sharpe", o.q(f"select strategy, case when n >= 60 and sr is not null then {len(NAMES)} end n_trials, round(case when n >= 60 then sr end, 6) + 0.0::double daily_sharpe, round(case when n >= 60 then sr * sqrt(252) end, 6) + 0.0::double annualized_sharpe, round(case when n >= 60 and sr is not null then bar * sqrt(252) end, 6) + 0.0::double threshold_from_n_trials, round(dsr, 6) + 0.0::double dsr from dsr", *_BT, *_DSR))
def deflated_sharpe(spark, sf_dir):
    """A row for each factor, as one of so many trials."""
    return r6(inference.deflated_sharpe(net_of(spark, panel_of(spark, sf_dir), list(NAMES)), len(NAMES)))


_GATES = """select strategy, gate, passed from (select strategy, unnest(['sharpe_positive', 'beats_baseline_ci', 'reality_check_significant', 'deflated_sharpe_solid']) gate, unnest([coalesce(sharpe > 0, false), coalesce(ci05 > 0, false), coalesce((select any_value(p_value) from rcheck) < 0.05, false), coalesce(dsr > 0.9, false)]) passed
 from (select strategy, case when days >= 40 then sharpe end sharpe from perf where strategy <> 'baseline_equal_weight' order by coalesce(case when days >= 40 then sharpe end, -9) desc, strategy limit 1) left join boot using (strategy) left join dsr using (strategy))"""


@register("deployment_gates", o.q(_GATES, *_BT3, *_BOOT_CTES, f"boot as ({_BOOT})", *_reality_ctes(1000), f"means as ({_MEANS})", f"rcheck as ({_REALITY_P})", o.PERF_CTE, *_DSR))
def deployment_gates(spark, sf_dir):
    """A row for each gate of the best factor, by the report's own rules, factors and replicates."""
    net = written(spark, net_of(spark, panel_of(spark, sf_dir), _ALL), "net")
    factors, active = net.where(F.col("strategy") != BASELINE), backtest.active(net)
    return inference.gates(backtest.performance(factors), inference.bootstrap(active, 2000, names=list(NAMES)), inference.reality_check(active, names=list(NAMES)), inference.deflated_sharpe(factors, len(NAMES)))


# ---------------------------------------------------------------- audit


@register("variance_ratio", o.q("select ticker, round(vr, 6) + 0.0::double vr, round(z, 6) + 0.0::double z from vr", o.COMPACT_CTE, o.VR_CTE))
def variance_ratio(spark, sf_dir):
    return r6(audit.variance_ratio(panel_of(spark, sf_dir)))


@register("ljung_box", o.q("select ticker, round(stat, 5) + 0.0::double stat, round(p_value, 6) + 0.0::double p_value from lb", o.COMPACT_CTE, o.LB_CTE))
def ljung_box(spark, sf_dir):
    return audit.ljung_box(panel_of(spark, sf_dir)).select("ticker", F.round("stat", 5).alias("stat"), F.round("p_value", 6).alias("p_value"))


@register("momentum_spread", o.q("select count(spread) periods, round(avg(spread) * 100, 6) + 0.0::double mean_monthly_spread_pct, round(avg(spread) / (stddev_samp(spread) / sqrt(count(spread))), 6) + 0.0::double t_stat, round(avg((spread > 0)::int::double), 6) + 0.0::double positive_share from spreads", o.SPREAD_CTE))
def momentum_spread(spark, sf_dir):
    return r6(audit.momentum_check(audit.momentum_spreads(panel_of(spark, sf_dir))))


@register("stock_audit", o.q("select ticker, days, round(ann_vol, 6) + 0.0::double ann_vol, round(traded_share, 6) + 0.0::double traded_share, round(variance_ratio_q5, 6) + 0.0::double variance_ratio_q5, round(z, 6) + 0.0::double z, round(ljung_box_p, 6) + 0.0::double ljung_box_p from stock_audit", o.AUDIT_CTE))
def stock_audit(spark, sf_dir):
    return r6(audit.stock_audit(panel_of(spark, sf_dir)))


@register("market_audit_summary", o.q("select count(*) tickers, round(median(traded_share), 6) + 0.0::double median_traded_share, count(*) filter (traded_share < 0.6) illiquid_stocks_below_60pct, round(median(variance_ratio_q5), 6) + 0.0::double median_vr_q5, count(*) filter (abs(z) > 1.959963984540054) stocks_rejecting_random_walk_5pct, round(avg((variance_ratio_q5 > 1)::int::double), 6) + 0.0::double share_vr_above_1, count(*) filter (ljung_box_p < 0.05) autocorrelation_ljung_box_significant, (select count(*) from cal) trading_days, (select min(date) from cal) first_date, (select max(date) from cal) last_date from stock_audit", o.AUDIT_CTE))
def market_audit_summary(spark, sf_dir):
    return r6(audit.market_summary(panel_of(spark, sf_dir)))


# ---------------------------------------------------------------- features and forecasts


@register("market_series", o.q("select date, round(mkt, 6) + 0.0::double mkt from market where mkt is not null", o.MARKET_CTE))
def market_series(spark, sf_dir):
    return r6(panels.market_series(panel_of(spark, sf_dir)).where("mkt is not null").select("date", "mkt"))


def _features(name: str, columns: list[str]):
    @register(name, o.q(f"select ticker, date, {o.rounded(columns)} from features where coalesce({', '.join(columns)}) is not null", o.FEATURES_CTE))
    def run(spark, sf_dir):
        rows = features.add_features(panel_of(spark, sf_dir)).select("ticker", "date", *columns)
        return r6(rows.where(F.coalesce(*columns).isNotNull()))


for _name, _columns in {"feat_momentum": ["mom_21", "mom_63", "mom_126", "reversal_5"], "feat_vol": ["vol_63", "vol_ratio"], "feat_high": ["dist_52w_high"], "feat_liquidity": ["amihud", "volume_shock"], "feat_beta": ["beta_63"], "feat_market": ["market_mom_63", "market_vol_21"], "feature_matrix": features.FEATURES}.items():
    _features(_name, _columns)


@register("fwd_returns", o.q("select ticker, date, round(fwd_21, 6) + 0.0::double fwd_21, round(fwd_63, 6) + 0.0::double fwd_63, round(fwd_126, 6) + 0.0::double fwd_126, round(fwd_252, 6) + 0.0::double fwd_252 from features where coalesce(fwd_21, fwd_63, fwd_126, fwd_252) is not null", o.FEATURES_CTE))
def fwd_returns(spark, sf_dir):
    c = [f"fwd_{h}" for h in features.HORIZONS.values()]
    return r6(features.add_targets(panel_of(spark, sf_dir)).select("ticker", "date", *c).where(F.coalesce(*c).isNotNull()))


_LAST_DAY = "d_idx = (select max(d_idx) from cal)"
_FULL = " and ".join(f"{c} is not null" for c in features.FEATURES)


def _daily_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The panel, and the same with features and targets; both are written, as refits, tests and skill each read them."""
    panel = written(spark, panel_of(spark, sf_dir), "panel")
    return panel, written(spark, features.add_targets(features.add_features(panel)), "features")


def _daily_samples(spark, sf_dir) -> DataFrame:
    """Rows of the daily panel with all features, once for each horizon whose target they have."""
    return forecast.samples(_daily_rows(spark, sf_dir)[1], features.HORIZONS)


def _ridge(spark, sf_dir) -> DataFrame:
    """The ridge's forecasts out of sample, of all horizons; written, as skill, bounds and quarters each read them."""
    return written(spark, forecast.walk_forward(_daily_samples(spark, sf_dir), model="ridge"), "oos")


_FOLDS = " union all ".join(
    f"""select '{label}' horizon, ((i - {150 + h}) // 42)::int refit_id, (date - {int(h * 1.6)})::date train_end, date test_start, test_end from (select date, row_number() over (order by date) - 1 i, count(*) over () n, coalesce(lead(date, 41) over (order by date), max(date) over ()) test_end from (select distinct date from features where fwd_{h} is not null and {_FULL})) where n >= {160 + h} and i >= {150 + h} and (i - {150 + h}) % 42 = 0"""
    for label, h in features.HORIZONS.items()
)


@register("purged_folds", o.q(_FOLDS, o.FEATURES_CTE))
def purged_folds(spark, sf_dir):
    return forecast.folds(_daily_samples(spark, sf_dir))


@register("ic_by_date", o.q("select date, n, round(rho, 6) + 0.0::double rho from ic", o.FEATURES_CTE, o.IC_CTE))
def ic_by_date(spark, sf_dir):
    rows = features.add_targets(features.add_features(panel_of(spark, sf_dir))).select("date", "mom_63", "fwd_21")
    return r6(forecast.rank_correlation(rows, "mom_63", "fwd_21", "date"))


def _graded(rows: DataFrame) -> DataFrame:
    """Momentum in place of a model's forecast, so that what is computed from forecasts has SQL to compare with."""
    return rows.where("mom_63 is not null and fwd_21 is not null").select(F.lit("1M").alias("horizon"), "date", "ticker", F.col("mom_63").alias("prediction"), F.col("fwd_21").alias("actual"))


@register("market_base", o.q("select round(coalesce(avg(mkt), 0), 8) + 0.0::double base from (select mkt, row_number() over (order by d_idx desc) k from market where mkt is not null) where k <= 252", o.MARKET_CTE))
def market_base(spark, sf_dir):
    """The mean market return of the last 252 dates, which forecasts are shrunk to."""
    base = forecast.market_base(panels.market_series(panel_of(spark, sf_dir)))
    return base.select((F.round("base", 8) + F.lit(0.0)).alias("base"))


_NOW = f"now_ as (select * from features where mom_63 is not null and {_LAST_DAY})"


@register("shrink_blend", o.q("""select ticker, '1M' horizon, round_even(100 * (exp(b * 21 + w * (mom_63 - b * 21)) - 1), 2) expected_return_pct, round_even(100 * (exp(mom_63) - 1), 2) raw_model_return_pct, round(w, 6) + 0.0::double skill_weight from now_ join trust on true""", o.FEATURES_CTE, o.IC_CTE, _NOW,
    "base_ as (select coalesce(avg(mkt), 0) b from (select mkt, row_number() over (order by d_idx desc) k from market where mkt is not null) where k <= 252)",
    "trust as (select (select b from base_) b, (select least(greatest(5 * avg(rho), 0), 0.5) from ic) w)"))
def shrink_blend(spark, sf_dir):
    """Momentum blended with the market's mean by its own skill."""
    panel, rows = _daily_rows(spark, sf_dir)
    now = forecast.latest(rows)
    skill = forecast.ic_summary(_graded(rows)).select("horizon", F.lit(21).alias("h"), forecast.skill_weight(F.col("ic")).alias("skill_weight"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    base = forecast.market_base(panels.market_series(panel))
    out = forecast.blended(now, skill.withColumn("base", base.scalar()), now.select(F.lit("1M").alias("horizon"), "ticker", F.col("mom_63").alias("raw")))
    return out.select("ticker", "horizon", "expected_return_pct", "raw_model_return_pct", F.round("skill_weight", 6).alias("skill_weight"))


_RANKS = " union all ".join(f"select ticker, '{f}' feature, {i} o, {f} x from now_ where {f} is not null" for i, f in enumerate(features.FEATURES))
_LABEL = "case feature " + " ".join(f"when '{f}' then '{label.replace(chr(39), chr(39) * 2)}'" for f, label in forecast.REASONS.items()) + " else feature end"


_REASONS = f"select ticker, coalesce(string_agg({_LABEL}, '; ' order by k) filter (k <= 3 and pct > 0.6), '{forecast.NO_REASON}') pourquoi from now_ left join (select *, row_number() over (partition by ticker order by pct desc, o) k from pcts) using (ticker) group by ticker"


@register("top10_reasons", o.q(_REASONS, o.FEATURES_CTE, _NOW, f"cells as ({_RANKS})", f"pcts as (select ticker, feature, o, ({o.rank_sql('x', 'feature')}) / count(*) over (partition by feature) pct from cells)"))
def top10_reasons(spark, sf_dir):
    return forecast.reasons(forecast.latest(features.add_features(panel_of(spark, sf_dir))))


_XX = [(i, j) for i in range(len(features.FEATURES)) for j in range(i, len(features.FEATURES))]
_TERMS = ", ".join([
    "count(*)::double n", "sum(actual) y", *[f"sum({f}) x{i}" for i, f in enumerate(features.FEATURES)], *[f"sum({f} * actual) xy{i}" for i, f in enumerate(features.FEATURES)],
    *[f"sum({features.FEATURES[i]} * {features.FEATURES[j]}) x{i}x{j}" for i, j in _XX],
])
_SAMPLES = "samples as (" + " union all ".join(f"select '{label}' horizon, date, ticker, fwd_{h} actual, {', '.join(features.FEATURES)} from features where fwd_{h} is not null and {_FULL}" for label, h in features.HORIZONS.items()) + ")"


_NAMES = features.FEATURES
_P = len(_NAMES)


def _fit(name: str, sums: str) -> tuple[str, ...]:
    """name (horizon, refit_id, b, w): the ridge of each row of sums, by elimination of all other rows (Gauss and Jordan), one feature at a time."""
    pair = lambda i, j: f"x{min(i, j)}x{max(i, j)}"
    spread = lambda i, j: f"({pair(i, j)} - x{i} * x{j} / n)"
    sds = ", ".join(f"case when {spread(i, i)} > 1e-12 * {pair(i, i)} then sqrt({spread(i, i)} / n) else 1 end" for i in range(_P))
    rows = ", ".join("[" + ", ".join([*[f"{spread(i, j)} / (sd[{i + 1}] * sd[{j + 1}]){' + 10' if i == j else ''}" for j in range(_P)], f"(xy{i} - x{i} * y / n) / sd[{i + 1}]"]) + "]" for i in range(_P))
    return (
        f"{name}_sd as (select *, [{sds}] sd from {sums} where n >= 200)",
        f"""{name}_m(horizon, refit_id, k, m) as (select horizon, refit_id, 0::bigint, [{rows}] from {name}_sd
 union all select horizon, refit_id, k + 1, list_transform(m, lambda r, i: case when i = k + 1 then r else list_transform(r, lambda x, j: x - m[k + 1][j] * r[k + 1] / m[k + 1][k + 1]) end) from {name}_m where k < {_P})""",
        f"{name}_w as (select horizon, refit_id, list_transform(m, lambda r, i: r[{_P + 1}] / r[i]) w from {name}_m where k = {_P})",
        f"{name} as (select horizon, refit_id, y / n - ({' + '.join(f'w[{i + 1}] / sd[{i + 1}] * x{i} / n' for i in range(_P))}) b, [{', '.join(f'w[{i + 1}] / sd[{i + 1}]' for i in range(_P))}] w from {name}_w join {name}_sd using (horizon, refit_id))",
    )


_FOLD_SUMS = (o.FEATURES_CTE, _SAMPLES, f"folds as ({_FOLDS})", f"rsums as (select f.horizon, f.refit_id, {_TERMS} from folds f join samples s on s.horizon = f.horizon and s.date <= f.train_end group by 1, 2)")
_OOS = (*_FOLD_SUMS, *_fit("fitted", "rsums"),
    f"oos as (select s.horizon, f.refit_id, s.date, s.ticker, s.actual, b + {' + '.join(f'w[{i + 1}] * {f}' for i, f in enumerate(_NAMES))} prediction from samples s join folds f on s.horizon = f.horizon and s.date >= f.test_start and s.date <= f.test_end join fitted m on m.horizon = f.horizon and m.refit_id = f.refit_id)")
_SKILL = (
    f"dr as (select horizon, date, {o.rank_sql('prediction', 'horizon, date')} ra, {o.rank_sql('actual', 'horizon, date')} rb from oos)",
    "dc as (select horizon, avg(rho) m, stddev_samp(rho) sd, count(rho) as days from (select horizon, date, case when stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then corr(ra, rb) end rho from dr group by 1, 2 having count(*) >= 8) group by 1)",
    f"pr as (select horizon, count(*) as rows_, case when stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then corr(ra, rb) end rho from (select horizon, {o.rank_sql('prediction', 'horizon')} ra, {o.rank_sql('actual', 'horizon')} rb from oos) group by 1)",
    """skill as (select horizon, case when rows_ < 50 then 0 when days >= 20 then m else coalesce(rho, 0) end ic,
 case when rows_ < 50 then 0 when days >= 20 then case when sd > 0 then m / (sd / sqrt(days)) else 0 end else coalesce(rho * sqrt(greatest(2.0, rows_ / 21.0) - 2) / sqrt(greatest(1e-9, 1 - rho ** 2)), 0) end t_stat,
 case when rows_ < 50 then rows_ when days >= 20 then days else rows_ end n, case when rows_ < 50 then null when days >= 20 then 'cross_sectional' else 'pooled_time_series' end as mode from pr left join dc using (horizon))""",
    "bounds as (select horizon, quantile_cont(actual - prediction, 0.05) low, quantile_cont(actual - prediction, 0.95) high from oos group by 1 having count(*) > 60)",
)
_ALPHA = (
    *_OOS, *_SKILL, "base_ as (select coalesce(avg(mkt), 0) base from (select mkt, row_number() over (order by d_idx desc) k from market where mkt is not null) where k <= 252)",
    f"hz as (select unnest({list(features.HORIZONS)}) horizon, unnest({list(features.HORIZONS.values())}) h)",
    "ht as (select horizon, h::int h, (select base from base_) base, coalesce(least(greatest(5 * ic, 0), 0.5), 0) skill_weight, low, high, coalesce(rows_, 0)::bigint oos_samples, ic, t_stat, n, mode from hz left join skill using (horizon) left join bounds using (horizon) left join (select horizon, rows_ from pr) using (horizon))",
    _NOW, f"fsums as (select horizon, 0 refit_id, {_TERMS} from samples group by 1)", *_fit("final", "fsums"),
    f"fraw as (select horizon, ticker, b + {' + '.join(f'w[{i + 1}] * coalesce({f}, 0)' for i, f in enumerate(_NAMES))} raw from now_, final)",
    "mixed as (select ticker, horizon, base * h + skill_weight * (coalesce(raw, base * h) - base * h) mix, coalesce(raw, base * h) raw, low, high, skill_weight from (select ticker from now_) join ht on true left join fraw using (horizon, ticker))",
    "forecasts as (select ticker, horizon, round_even(100 * (exp(mix) - 1), 2) expected_return_pct, round_even(100 * (exp(raw) - 1), 2) raw_model_return_pct, round_even(100 * (exp(mix + low) - 1), 2) low_5pct, round_even(100 * (exp(mix + high) - 1), 2) high_95pct, skill_weight from mixed)",
)


@register("ridge_sums", o.q(f"select horizon, refit_id, {', '.join(f'round({c}, 4) + 0.0::double {c}' for c in forecast.SUMS)} from rsums", *_FOLD_SUMS))
def ridge_sums(spark, sf_dir):
    """What each refit of the ridge is solved from: sums over all the rows that it trains on."""
    data = _daily_samples(spark, sf_dir)
    sums = forecast.gram_sums(data, forecast.folds(data)).where("n > 0")
    return sums.select("horizon", "refit_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in forecast.SUMS])


@register("ridge_forecast", o.q("select horizon, refit_id, date, ticker, round(actual, 6) + 0.0::double actual, round(prediction, 6) + 0.0::double prediction from oos", *_OOS))
def ridge_forecast(spark, sf_dir):
    return r6(forecast.walk_forward(_daily_samples(spark, sf_dir), model="ridge"))


@register("ic_summary", o.q("select horizon, round(ic, 6) + 0.0::double ic, round(t_stat, 6) + 0.0::double t_stat, n, mode from skill", *_OOS, *_SKILL))
def ic_summary(spark, sf_dir):
    """The skill of the ridge out of sample, of all horizons."""
    return r6(forecast.ic_summary(_ridge(spark, sf_dir)))


@register("residual_quantiles", o.q("select horizon, round(low, 6) + 0.0::double low, round(high, 6) + 0.0::double high from bounds", *_OOS, *_SKILL))
def residual_quantiles(spark, sf_dir):
    return r6(forecast.residual_bounds(_ridge(spark, sf_dir)))


@register("quarterly_top10", o.q("""select count(x) as quarters, case when count(x) >= 3 then round(avg(x) * 100, 6) + 0.0::double end mean_quarterly_excess_pct, case when count(x) >= 3 then round(case when stddev_samp(x) > 0 then avg(x) / (stddev_samp(x) / sqrt(count(x))) else 0 end, 6) + 0.0::double end t_stat, case when count(x) >= 3 then round(avg((x > 0)::int::double), 6) + 0.0::double end positive_share from
(select date, avg(actual) filter (k <= 10) - avg(actual) x from (select date, actual, row_number() over (partition by date order by prediction desc, ticker) k, count(*) over (partition by date) n, dense_rank() over (order by date) - 1 i from oos where horizon = '3M') where n >= 12 and i % 63 = 0 group by date)""", *_OOS))
def quarterly_top10(spark, sf_dir):
    """What the ridge's ten best forecasts for three months earned over all, each quarter."""
    return r6(forecast.quarterly(_ridge(spark, sf_dir).where("horizon = '3M'")))


@register("gbm_forecast")
def gbm_forecast(spark, sf_dir):
    return r6(forecast.walk_forward(_daily_samples(spark, sf_dir)))


def _alpha(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the report makes of the ridge alone: skill by horizon, forecasts of the last date, and that date's features."""
    panel, rows = _daily_rows(spark, sf_dir)
    data, now = forecast.samples(rows, features.HORIZONS), forecast.latest(rows)
    oos = written(spark, forecast.walk_forward(data, model="ridge"), "oos")
    table = written(spark, forecast.horizon_table(oos, features.HORIZONS, panels.market_series(panel)), "horizons")
    return table, forecast.blended(now, table, forecast.final_forecasts(data, now, "ridge")), now


@register("alpha_horizons", o.q(f"select horizon, h, oos_samples, n, mode, {o.rounded(['base', 'skill_weight', 'low', 'high', 'ic', 't_stat'])} from ht", *_ALPHA))
def alpha_horizons(spark, sf_dir):
    """The skill of the ridge at each horizon, and the trust that its forecasts get."""
    return r6(_alpha(spark, sf_dir)[0])


@register("alpha_forecasts", o.q(f"select ticker, horizon, {o.rounded(['expected_return_pct', 'raw_model_return_pct', 'low_5pct', 'high_95pct', 'skill_weight'])} from forecasts", *_ALPHA))
def alpha_forecasts(spark, sf_dir):
    """The ridge's forecasts of the last date, of every ticker and horizon."""
    return r6(_alpha(spark, sf_dir)[1])


@register("alpha_top10", o.q(f"""select ticker "Valeur", expected_return_pct "Prevision 3M %", low_5pct "Pire cas 5%", high_95pct "Meilleur cas 95%", pourquoi "Pourquoi" from (select *, row_number() over (order by expected_return_pct desc, ticker) k from forecasts where horizon = '3M') join reasons using (ticker) where k <= 10""",
    *_ALPHA, f"cells as ({_RANKS})", f"pcts as (select ticker, feature, o, ({o.rank_sql('x', 'feature')}) / count(*) over (partition by feature) pct from cells)", f"reasons as ({_REASONS})"))
def alpha_top10(spark, sf_dir):
    """The ten best forecasts for three months, with reasons, as the dashboard shows them."""
    _, forecasts, now = _alpha(spark, sf_dir)
    return dashboard.top_ten(forecast.top_ten(forecasts, now))


_L0 = "(ln(share) - ln(2 * pi() * v0) / 2 - (x - m0) ** 2 / (2 * v0))"
_L1 = "(ln(1 - share) - ln(2 * pi() * v1) / 2 - (x - m1) ** 2 / (2 * v1))"
_CHANCE, _LEVEL = f"1 / (1 + exp({_L1} - {_L0}))", f"ln(exp({_L0}) + exp({_L1}))"
_STEP = "greatest(sum(r), 1e-9) n0, greatest(sum(1 - r), 1e-9) n1, sum(r * x) s0, sum(r * x * x) q0, sum((1 - r) * x) s1, sum((1 - r) * x * x) q1"
_NEW = "n0 / (n0 + n1), s0 / n0, greatest(q0 / n0 - (s0 / n0) ** 2, 0) + 1e-6, s1 / n1, greatest(q1 / n1 - (s1 / n1) ** 2, 0) + 1e-6"


@register("regime", o.q("""select case when n < 120 then 'inconnu' when calm > 0.5 then 'CALME' else 'STRESS' end regime, case when n >= 120 then round(calm, 5) + 0.0::double end calm_probability, case when n >= 120 then round(sqrt(least(v0, v1) * 252), 6) + 0.0::double end calm_ann_vol, case when n >= 120 then round(sqrt(greatest(v0, v1) * 252), 6) + 0.0::double end stress_ann_vol
from (select (select count(*) from mx) n, (select avg(case when v0 <= v1 then r else 1 - r end) from (select *, """ + _CHANCE + """ r from fin, (select x from mx order by d_idx desc limit 21))) calm, (select v0 from fin) v0, (select v1 from fin) v1)""",
    o.MARKET_CTE, "mx as (select d_idx, mkt x from market where mkt is not null)",
    f"em0(share, m0, v0, m1, v1) as (select {_NEW} from (select {_STEP} from (select x, (abs(x - m) <= median(abs(x - m)) over ())::int::double r from mx, (select avg(x) m from mx))))",
    f"""em(i, share, m0, v0, m1, v1, l, gain) as (select 0, share, m0, v0, m1, v1, 0::double, 1e300::double from em0
 union all select i + 1, {_NEW}, level, case when i = 0 then 1e300 else level - l end from (select i, l, avg(lk) level, {_STEP} from (select i, em.l, x, {_CHANCE} r, {_LEVEL} lk from em, mx where gain >= 1e-5 and i < 200) group by i, l))""",
    "fin as (select * from em where i = (select case when min(gain) < 1e-5 then max(i) - 1 else max(i) end from em))"))
def regime(spark, sf_dir):
    """Calm or stressed, by a mixture of two normals over the market's returns."""
    got = forecast.market_regime(panels.market_series(panel_of(spark, sf_dir)))
    return got.select("regime", (F.round("calm_probability", 5) + F.lit(0.0)).alias("calm_probability"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("calm_ann_vol", "stress_ann_vol")])


# ---------------------------------------------------------------- portfolio


@register("cov_pairs", o.q("select a.ticker a, b.ticker b, round(covar_pop(a.r, b.r), 8) + 0.0::double cov from xs a join xs b on a.d_idx = b.d_idx and a.ticker <= b.ticker group by 1, 2", "xs as (select ticker, d_idx, coalesce(ret, 0) r from panel where d_idx > (select max(d_idx) from cal) - 180)"))
def cov_pairs(spark, sf_dir):
    return portfolio.covariance_pairs(portfolio.recent_returns(panel_of(spark, sf_dir))).select("a", "b", (F.round("cov", 8) + F.lit(0.0)).alias("cov"))


_XS = "xs as (select ticker, d_idx, coalesce(ret, 0) - avg(coalesce(ret, 0)) over (partition by ticker) r from panel where d_idx > (select max(d_idx) from cal) - 180)"
_PAIRS = (
    "prs as (select a.ticker a, b.ticker b, avg(a.r * b.r) s, avg((a.r * b.r) ** 2) q, count(*) n from xs a join xs b on a.d_idx = b.d_idx and a.ticker <= b.ticker group by 1, 2)",
    "tot as (select max(n) n, count(*) filter (a = b) p, sum(s) filter (a = b) tr, sum(case when a = b then 1 else 2 end * s * s) s2, sum(case when a = b then 1 else 2 end * q) q2 from prs)",
    "lw as (select tr / p mu, case when s2 / p - (tr / p) ** 2 > 0 then least((q2 - s2) / (p * n), s2 / p - (tr / p) ** 2) / (s2 / p - (tr / p) ** 2) else 0 end share from tot)",
    "shr as (select a, b, (1 - share) * s + case when a = b then share * mu else 0 end cov from prs, lw)",
)
_SHRUNK = (_XS, *_PAIRS)
_DISTANCES = "select x.a, x.b, case when x.a = x.b then 0 else sqrt(least(greatest(0.5 * (1 - x.cov / sqrt(i.cov * j.cov)), 0), 1)) end dist from shr x join shr i on i.a = x.a and i.b = x.a join shr j on j.a = x.b and j.b = x.b"


def _parity(chosen: str = "true") -> tuple[str, ...]:
    """hw (ticker, weight): risk parity of the chosen tickers. All pairs by length, one after another, join clusters; then halves of the order, level by level."""
    return (
        f"hx as (select ticker, d_idx, ret from panel where d_idx > (select max(d_idx) from cal) - 180 and {chosen})",
        "hc as (select ticker from hx group by ticker having count(ret) >= floor((select count(distinct d_idx) from hx) * 0.6))",
        "xs as (select ticker, d_idx, coalesce(ret, 0) - avg(coalesce(ret, 0)) over (partition by ticker) r from hx semi join hc using (ticker))",
        *_PAIRS,
        f"dis as ({_DISTANCES})",
        "ed as (select a, b, row_number() over (order by dist, a, b) i from dis where a < b)",
        """kr(i, cl) as (select 0::bigint, (select list({made: k, items: [a]} order by a) from (select a, row_number() over (order by a) k from dis where a = b))
 union all select ed.i, case when len(list_filter(cl, lambda c: list_contains(c.items, a) or list_contains(c.items, b))) = 1 then cl
  else list_append(list_filter(cl, lambda c: not (list_contains(c.items, a) or list_contains(c.items, b))), {made: (list_max(list_transform(cl, lambda c: c.made)) + 1)::bigint, items: list_concat(list_sort(list_filter(cl, lambda c: list_contains(c.items, a) or list_contains(c.items, b)))[1].items, list_sort(list_filter(cl, lambda c: list_contains(c.items, a) or list_contains(c.items, b)))[2].items)}) end
 from kr join ed on ed.i = kr.i + 1)""",
        "ord as (select unnest(cl[1].items) ticker, unnest(range(len(cl[1].items))) pos from kr where i = (select count(*) from ed))",
        """hn(level, first, size, parent) as (select 0::bigint, 0::bigint, (select count(*) from ord), -1::bigint
 union all select level + 1, first + side * (size // 2), case side when 0 then size // 2 else size - size // 2 end, first from hn, (select unnest([0, 1]) side) where size >= 2)""",
        "cf as (select a, b, cov from shr union all select b, a, cov from shr where a <> b)",
        "iv as (select o.pos, o.ticker, 1 / greatest(cov, 1e-10) inv from ord o join shr on a = ticker and b = ticker)",
        "va as (select level, first, parent, sum(i.inv * j.inv * cov) / sum(i.inv * j.inv) v from hn join iv i on i.pos >= first and i.pos < first + size join iv j on j.pos >= first and j.pos < first + size join cf on a = i.ticker and b = j.ticker where level > 0 group by all)",
        "sa_ as (select level, first, case when sum(v) over (partition by level, parent) > 0 then 1 - v / sum(v) over (partition by level, parent) else 0.5 end share from va)",
        "pw as (select o.ticker, coalesce(product(share), 1) w from ord o left join (select * from hn join sa_ using (level, first)) n on pos >= first and pos < first + size group by 1)",
        "hw as (select ticker, w / sum(w) over () weight from pw)",
    )




def _market(spark, sf_dir) -> DataFrame:
    """The last 180 dates' returns of all tickers, as one portfolio."""
    return portfolio.recent_returns(panel_of(spark, sf_dir)).select(F.lit("all").alias("portfolio"), "ticker", "d_idx", "ret")


@register("ledoit_wolf", o.q("select a, b, round(cov, 8) + 0.0::double cov from shr", *_SHRUNK))
def ledoit_wolf(spark, sf_dir):
    return portfolio.shrunk_pairs(_market(spark, sf_dir)).select("a", "b", (F.round("cov", 8) + F.lit(0.0)).alias("cov"))


@register("corr_distance", o.q(f"select a, b, round(dist, 6) + 0.0::double dist from ({_DISTANCES})", *_SHRUNK))
def corr_distance(spark, sf_dir):
    return r6(portfolio.correlation_distances(portfolio.shrunk_pairs(_market(spark, sf_dir))).select("a", "b", "dist"))


_INV = f"inv0 as (select ticker, d_idx, {o.roll('stddev_samp', 'ret', 63)} vol from panel), inv1 as (select v.ticker, case when vol is null then 0 else 1 / greatest(vol, 0.004) end inv from inv0 v join elig e using (ticker, d_idx) where d_idx = (select max(d_idx) from cal) and eligible), inv as (select ticker, inv / sum(inv) over () weight from inv1)"
_CAP = "capped as (select ticker, least(weight, 0.12) / sum(least(weight, 0.12)) over () weight from inv)"


def _inverse(panel: DataFrame) -> DataFrame:
    return portfolio.inverse_volatility(panel, portfolio.selection(backtest.eligibility(panel)))


@register("inverse_vol_weights", o.q("select ticker, round(weight, 6) + 0.0::double weight from inv", o.ELIGIBLE_CTE, _INV))
def inverse_vol_weights(spark, sf_dir):
    return r6(_inverse(panel_of(spark, sf_dir)))


@register("capped_weights", o.q("select ticker, round(weight, 6) + 0.0::double weight from capped", o.ELIGIBLE_CTE, _INV, _CAP))
def capped_weights(spark, sf_dir):
    return r6(portfolio.capped(_inverse(panel_of(spark, sf_dir))))


def _sized(capped: str) -> str:
    return f"""select ticker, round_even(100 * target / 100000.0, 2) weight_pct, round_even(target, 0) target_mad, round_even(close, 2) last_price, trunc(target / close)::bigint shares from
(select c.ticker, a.close, least(c.weight * 100000.0, a.adv * 3) target from {capped} c join (select ticker, d_idx, close, {o.roll('median', 'volume * close', 63)} adv from panel) a on a.ticker = c.ticker and a.d_idx = (select max(d_idx) from cal)) where round_even(target, 0) > 0"""


@register("position_sizing", o.q(_sized("capped"), o.ELIGIBLE_CTE, _INV, _CAP))
def position_sizing(spark, sf_dir):
    p = written(spark, panel_of(spark, sf_dir), "panel")
    return portfolio.sized(portfolio.capped(_inverse(p)), p)


@register("hrp_weights", o.q("select 'all' portfolio, ticker, round(weight, 6) + 0.0::double weight from hw", *_parity()))
def hrp_weights(spark, sf_dir):
    return r6(portfolio.hrp_weights(_market(spark, sf_dir)))


def _parity_of(p: DataFrame, chosen: DataFrame) -> DataFrame:
    returns = portfolio.recent_returns(p).join(chosen.select("ticker"), "ticker", "left_semi").select(F.lit("chosen").alias("portfolio"), "ticker", "d_idx", "ret")
    return portfolio.sized(portfolio.capped(portfolio.hrp_weights(written(p.sparkSession, returns, "returns")).select("ticker", "weight")), p)


_CAPPED_HRP = "hcap as (select ticker, least(weight, 0.12) / sum(least(weight, 0.12)) over () weight from hw)"
_LAST = "d_idx = (select max(d_idx) from cal)"


@register("hrp_portfolio", o.q(_sized("hcap"), o.ELIGIBLE_CTE, *_parity(f"ticker in (select ticker from elig where eligible and {_LAST})"), _CAPPED_HRP))
def hrp_portfolio(spark, sf_dir):
    """The positions of the baseline portfolio: risk parity of the eligible tickers, capped by weight and by liquidity."""
    p = written(spark, panel_of(spark, sf_dir), "panel")
    return _parity_of(p, portfolio.selection(backtest.eligibility(p)))


_BEST_FIFTH = "(select ticker from (select ticker, row_number() over (order by composite desc, ticker) k, count(*) over () n from fs) where k <= greatest(5, ceil(n * 0.2)))"


@register("factor_portfolio", o.q(_sized("hcap"), o.FACTORS_CTE, o.ELIGIBLE_CTE, f"fs as (select ticker, composite from factors join elig using (ticker, d_idx) where eligible and composite is not null and factors.{_LAST})", *_parity(f"ticker in {_BEST_FIFTH}"), _CAPPED_HRP))
def factor_portfolio(spark, sf_dir):
    """The positions of a portfolio in factor mode: risk parity of the best fifth of the eligible tickers by the composite factor, capped."""
    p = written(spark, panel_of(spark, sf_dir), "panel")
    f = add_factors(p, ["composite"])
    scores = f.where(F.col("d_idx") == p.agg(F.max("d_idx")).scalar()).select("ticker", F.col("composite").alias("score"))
    return _parity_of(p, portfolio.selection(backtest.eligibility(p), scores))


# ---------------------------------------------------------------- dashboard


@register("dash_forecasts", o.q("select ticker, horizon, (row_number() over (partition by ticker order by h))::bigint place, expected_return_pct, low_5pct, high_95pct from forecasts join hz using (horizon)", *_ALPHA))
def dash_forecasts(spark, sf_dir):
    """Each ticker's forecasts in the order of their horizons, as its page shows them."""
    return dashboard.forecasts_in_order(_alpha(spark, sf_dir)[1])


@register("dash_performance", o.q("""select ticker, round(last_price, 6) + 0.0::double last_price, round(ret_1m_pct, 6) + 0.0::double ret_1m_pct, round(ret_3m_pct, 6) + 0.0::double ret_3m_pct, round(ret_1y_pct, 6) + 0.0::double ret_1y_pct, round(ann_vol_pct, 6) + 0.0::double ann_vol_pct from (select ticker, close last_price, 100 * (close / lag(close, 21) over w - 1) ret_1m_pct, 100 * (close / lag(close, 63) over w - 1) ret_3m_pct, 100 * (close / lag(close, 252) over w - 1) ret_1y_pct, 100 * sqrt(252) * stddev_samp(own) over (partition by ticker) ann_vol_pct, row_number() over (partition by ticker order by d_idx desc) k from (select *, ln(close / lag(close) over (partition by ticker order by d_idx)) own from panel where close is not null) window w as (partition by ticker order by d_idx)) where k = 1"""))
def dash_performance(spark, sf_dir):
    return r6(dashboard.performance(panel_of(spark, sf_dir)))


@register("dash_ma50", o.q(f"select ticker, date, round(close, 6) + 0.0::double as close, volume, round({o.roll('avg', 'close', 50)}, 6) + 0.0::double ma50 from panel where close is not null"))
def dash_ma50(spark, sf_dir):
    return r6(dashboard.moving_average(panel_of(spark, sf_dir)))


@register("factor_leaderboard", o.q("select strategy, round(sharpe, 3) + 0.0::double sharpe, round(100 * ann_return, 2) + 0.0::double ann_return_pct, round(100 * max_drawdown, 2) + 0.0::double max_drawdown_pct, round(avg_daily_turnover, 4) + 0.0::double avg_daily_turnover from perf where strategy <> 'baseline_equal_weight'", *_BT, o.PERF_CTE))
def factor_leaderboard(spark, sf_dir):
    perf = backtest.performance(net_of(spark, panel_of(spark, sf_dir), _ALL)).where(F.col("strategy") != BASELINE)
    return dashboard.leaderboard(perf)


@register("dash_audit_by_vr", o.q("select ticker, round(variance_ratio_q5, 6) + 0.0::double variance_ratio_q5, round(traded_share, 6) + 0.0::double traded_share from stock_audit", o.AUDIT_CTE))
def dash_audit_by_vr(spark, sf_dir):
    return r6(dashboard.audit_by_ratio(audit.stock_audit(panel_of(spark, sf_dir))))


# ---------------------------------------------------------------- sources and streams


def _price_files(spark, sf_dir) -> str:
    """A folder with the sales tables' prices as files of three layouts, by year: long with semicolons and French headers and numbers, wide with a column for each ticker (closes only), and quoted with separators in names."""
    folder = shared_path(spark, "raw")
    p = written(spark, sales_prices(spark, sf_dir).where("close > 0"), "prices").withColumn("kind", F.year("date") % 3)
    day, number = F.date_format("date", "dd/MM/yyyy"), lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    long = p.where("kind = 0").select(day.alias("Date de cotation"), F.concat(F.lit(" "), F.lower("ticker")).alias("Libellé"), number("close").alias("Cours de clôture"), number("volume").alias("Nombre de titres"))
    long.write.csv(f"{folder}/long", header=True, sep=";")
    tickers = sorted(r.ticker for r in p.select("ticker").distinct().collect())  # a row for each ticker
    p.where("kind = 1").groupBy("date").pivot("ticker", tickers).agg(F.max("close")).coalesce(1).write.csv(f"{folder}/wide", header=True)  # a row for each date
    quoted = p.where("kind = 2").select(F.col("volume").alias("titres, echanges"), F.date_format("date", "yyyy-MM-dd").alias("Seance"), F.col("ticker").alias("Valeur, nom"), F.col("close").alias("Dernier, cours"))
    quoted.write.csv(f"{folder}/quoted", header=True, quoteAll=True)
    return folder


_FILES = "select upper(ticker) ticker, date, round(close, 6) + 0.0::double as close, case when year(date) % 3 <> 1 then volume end volume from prices where close > 0"


@register("price_files_source", o.q(_FILES))
def price_files_source(spark, sf_dir):
    """Prices written as long, wide and quoted files, and read back by the data source."""
    return r6(read_prices(spark, _price_files(spark, sf_dir)).select("ticker", "date", "close", "volume"))


@register("price_files_dataset", o.q(_FILES))
def price_files_dataset(spark, sf_dir):
    """The same files, read by groups of equal headers."""
    prices, _ = build_dataset(spark, _price_files(spark, sf_dir))
    return r6(prices.select("ticker", "date", "close", "volume"))


@register("panel_of_files", o.q("select upper(ticker) ticker, date, round(close, 6) + 0.0::double as close, round(ret, 6) + 0.0::double ret from panel"))
def panel_of_files(spark, sf_dir):
    """The panel over prices from files: duplicates would be averaged."""
    return r6(panels.to_panel(written(spark, read_prices(spark, _price_files(spark, sf_dir)), "prices")).select("ticker", "date", "close", "ret"))


@register("synthetic_demo")
def synthetic_demo(spark, sf_dir):
    """Invented prices of a market of the sales tables' size: as many stocks as there are tickers, as many days as dates."""
    from ..sources.synthetic import generate

    size = sales_prices(spark, sf_dir).agg(F.countDistinct("ticker").alias("stocks"), F.countDistinct("date").alias("days")).first()
    return generate(spark, size.stocks, size.days)


@register("stream_daily_bars", "select event_type ticker, ts::date as date, count(*) n, round(max(value), 6) + 0.0::double high, round(min(value), 6) + 0.0::double low, round(sum(value), 4) + 0.0::double volume from events where value is not null group by 1, 2")
def stream_daily_bars(spark, sf_dir):
    from ..streaming.bars import bars_once

    b = bars_once(spark, f"{sf_dir}/events.parquet")
    return b.select("ticker", "date", "n", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"), F.round("volume", 4).alias("volume"))
