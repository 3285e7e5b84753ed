"""The registered queries of the library in SQL, for another engine to compare with. Each text stands alone."""

from __future__ import annotations

import re
from math import e
from statistics import NormalDist

from ..operators.factors import COMPOSED, FACTORS, NAMES
from ..operators.features import FEATURES


def base() -> str:
    return """with prices as (select p_brand ticker, cast(l_shipdate as date) date, max(l_extendedprice / l_quantity) as close, sum(l_quantity) volume from lineitem join part on l_partkey = p_partkey group by 1, 2),
cal as (select date, (row_number() over (order by date) - 1)::bigint d_idx from (select distinct date from prices)),
grid as (select t.ticker, c.date, c.d_idx, p.close raw_close, p.volume from cal c cross join (select distinct ticker from prices) t left join prices p on p.ticker = t.ticker and p.date = c.date),
ff as (select *, last_value(raw_close ignore nulls) over (partition by ticker order by d_idx rows between 10 preceding and current row) as close from grid),
rr as (select ticker, date, d_idx, close, volume, ln(close / lag(close) over (partition by ticker order by d_idx)) ret from ff),
panel as (select *, coalesce(abs(ret) > 1e-12, false) traded from rr)"""


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    over = f"over (partition by ticker order by d_idx rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {over} >= {n if least is None else least} then {agg}({x}) {over} end"


def back(n: int, c: str = "close") -> str:
    return f"lag({c}, {n}) over (partition by ticker order by d_idx)"


def ahead(n: int) -> str:
    return f"lead(close, {n}) over (partition by ticker order by d_idx)"


_V = "nullif(volume, 0)"
_AMIHUD = f"ln(1 + 1e6 * ({roll('avg', 'abs(ret) / nullif(volume * close, 0)', 63, 20)}))"
_SHOCK = f"ln(({roll('avg', _V, 5)}) / ({roll('avg', _V, 63, 20)}))"
FACTOR_SQL = {
    "momentum_126_21": f"ln({back(21)} / {back(126)})",
    "momentum_63_10": f"ln({back(10)} / {back(63)})",
    "reversal_5d": f"-({roll('sum', 'ret', 5)})",
    "reversal_21d": f"-({roll('sum', 'ret', 21)})",
    "low_volatility": f"-({roll('stddev_samp', 'ret', 63)})",
    "high_52w": f"close / ({roll('max', 'close', 252, 60)})",
    "amihud_illiquidity": _AMIHUD,
    "abnormal_volume": _SHOCK,
    "trend_ma_20_100": f"({roll('avg', 'close', 20)}) / ({roll('avg', 'close', 100, 60)}) - 1",
}
assert list(FACTOR_SQL) == list(FACTORS)
_Z = {n: f"({n} - avg({n}) over (partition by date)) / nullif(stddev_samp({n}) over (partition by date), 0)" for n in COMPOSED}
FACTORS_CTE = f"""f9 as (select *, {', '.join(f'{e} as {n}' for n, e in FACTOR_SQL.items())} from panel),
fz as (select *, {', '.join(f'{e} as z{i}' for i, e in enumerate(_Z.values()))} from f9),
factors as (select *, list_avg(list_filter([z0, z1, z2, z3, z4], lambda x: x is not null)) composite from fz)"""
ELIGIBLE_CTE = f"""el0 as (select *, case when count(*) over w >= 20 then avg(traded::int::double) over w end traded_share, {roll('median', 'volume * close', 63, 20)} money_volume from panel window w as (partition by ticker order by d_idx rows between 62 preceding and current row)),
elig as (select *, coalesce(traded_share >= 0.6, false) and ((select count(volume) from panel) = 0 or coalesce(money_volume >= 50000, false)) eligible from el0)"""


def scores_cte(names: list[str]) -> str:
    parts = [f"select '{n}' strategy, f.ticker, f.d_idx, f.{n} score, e.eligible from factors f join elig e using (ticker, d_idx)" for n in names if n != "baseline_equal_weight"]
    if "baseline_equal_weight" in names:
        parts.append("select 'baseline_equal_weight' strategy, ticker, d_idx, 1.0::double score, eligible from elig")
    return "scores as (" + " union all ".join(parts) + ")"


NET_CTE = """ranked as (select strategy, d_idx, ticker, row_number() over (partition by strategy, d_idx order by score desc, ticker) k, count(*) over (partition by strategy, d_idx) n, case when strategy = 'baseline_equal_weight' then 1.0::double else 0.2::double end q from scores where d_idx % 5 = 0 and eligible and score is not null),
goals as (select strategy, d_idx, ticker, 1.0::double / greatest(3, ceil(n * q)) weight from ranked where n >= 5 and k <= greatest(3, ceil(n * q))),
reb as (select distinct strategy, d_idx from goals),
lastreb as (select strategy, c.d_idx, max(r.d_idx) over (partition by strategy order by c.d_idx rows unbounded preceding) at_ from (select distinct strategy from reb) s cross join cal c left join reb r using (strategy, d_idx)),
weights as (select l.strategy, l.d_idx, g.ticker, g.weight from lastreb l join goals g on g.strategy = l.strategy and g.d_idx = l.at_),
lagged as (select strategy, ticker, d_idx + 1 d_idx, weight w from weights),
both_ as (select coalesce(a.strategy, b.strategy) strategy, coalesce(a.ticker, b.ticker) ticker, coalesce(a.d_idx, b.d_idx) d_idx, coalesce(a.w, 0) w, coalesce(b.w0, 0) w0 from lagged a full join (select strategy, ticker, d_idx + 1 d_idx, w w0 from lagged) b on a.strategy = b.strategy and a.ticker = b.ticker and a.d_idx = b.d_idx),
net0 as (select strategy, d_idx, sum(w * coalesce(ret, 0)) gross, sum(abs(w - w0)) turnover from both_ join panel using (ticker, d_idx) group by all),
net as (select s.strategy, c.date, c.d_idx, coalesce(gross, 0) gross, coalesce(turnover, 0) turnover, coalesce(gross - turnover * 0.01, 0) net from (select distinct strategy from scores) s cross join cal c left join net0 n on n.strategy = s.strategy and n.d_idx = c.d_idx where c.d_idx >= 130)"""
PERF_CTE = """curve as (select *, sum(net) over (partition by strategy order by d_idx rows unbounded preceding) equity from net),
dd as (select *, equity - max(equity) over (partition by strategy order by d_idx rows unbounded preceding) drawdown from curve),
perf as (select strategy, avg(net) * 252 ann_return, stddev_samp(net) * sqrt(252) ann_vol, min(drawdown) max_drawdown, avg((net > 0)::int::double) hit_rate, count(net) as days, avg(turnover) avg_daily_turnover, case when stddev_samp(net) > 0 then avg(net) * 252 / (stddev_samp(net) * sqrt(252)) else 0 end sharpe from dd group by strategy)"""
COMPACT_CTE = """cr as (select ticker, row_number() over (partition by ticker order by d_idx) i, ret - avg(ret) over (partition by ticker) d, count(*) over (partition by ticker) n from panel where ret is not null)"""
_VRP = ", ".join(f"d * d * lag(d, {k}) over (partition by ticker order by i) * lag(d, {k}) over (partition by ticker order by i) p{k}" for k in range(1, 5))
_THETA = " + ".join(f"{(2 * (5 - k) / 5) ** 2!r} * sum(p{k}) / (sum(d * d) * sum(d * d) / n)" for k in range(1, 5))
VR_CTE = f"""vr0 as (select *, case when i >= 5 then sum(d) over (partition by ticker order by i rows between 4 preceding and current row) end dq, {_VRP} from cr where n >= 100),
vr as (select ticker, sum(dq * dq) / (n * 5) / (sum(d * d) / n) vr, (sum(dq * dq) / (n * 5) / (sum(d * d) / n) - 1) / sqrt({_THETA}) z from vr0 group by ticker, n)"""
_LBC = ", ".join(f"d * lag(d, {k}) over (partition by ticker order by i) c{k}" for k in range(1, 11))
_LBQ = " + ".join(f"(sum(c{k}) / sum(d * d)) ** 2 / (n - {k})" for k in range(1, 11))
LB_CTE = f"""lb0 as (select ticker, n, d, {_LBC} from cr where n >= 100),
lb1 as (select ticker, n * (n + 2) * ({_LBQ}) stat from lb0 group by ticker, n),
lb as (select ticker, stat, exp(-stat / 2) * (1 + stat / 2 + (stat / 2) ** 2 / 2 + (stat / 2) ** 3 / 6 + (stat / 2) ** 4 / 24) p_value from lb1)"""
SPREAD_CTE = f"""sp0 as (select ticker, d_idx, ln({back(21)} / {back(126)}) signal, ln({ahead(21)} / close) future from panel),
sp1 as (select *, count(*) over (partition by d_idx) n, row_number() over (partition by d_idx order by signal desc, ticker) up, row_number() over (partition by d_idx order by signal, ticker) down from sp0 where signal is not null and d_idx >= 126 and d_idx < (select max(d_idx) + 1 - 21 from cal) and (d_idx - 126) % 21 = 0),
spreads as (select * from (select d_idx, avg(future) filter (up <= greatest(3, n // 5)) - avg(future) filter (down <= greatest(3, n // 5)) spread from sp1 where n >= 10 group by d_idx, n) where spread is not null)"""
AUDIT_CTE = f"""{COMPACT_CTE}, {VR_CTE}, {LB_CTE},
sa as (select p.ticker, count(ret) as days, stddev_pop(ret) * sqrt(252) ann_vol, avg(traded::int::double) traded_share from panel p group by 1),
stock_audit as (select sa.*, vr.vr variance_ratio_q5, vr.z, lb.p_value ljung_box_p from sa left join vr using (ticker) left join lb using (ticker))"""
MARKET_CTE = """market as (select date, d_idx, avg(ret) mkt from panel group by 1, 2),
mf as (select *, case when count(mkt) over w63 >= 63 then sum(mkt) over w63 end market_mom_63, case when count(mkt) over w21 >= 21 then stddev_samp(mkt) over w21 end market_vol_21 from market window w63 as (order by d_idx rows between 62 preceding and current row), w21 as (order by d_idx rows between 20 preceding and current row))"""
_BETA = "over (partition by ticker order by d_idx rows between 62 preceding and current row)"
FEATURES_CTE = f"""{MARKET_CTE},
pm as (select panel.*, mkt, market_mom_63, market_vol_21 from panel left join mf using (date, d_idx)),
fe0 as (select *, ln(close / {back(21)}) mom_21, ln(close / {back(63)}) mom_63, ln({back(21)} / {back(126)}) mom_126, -({roll('sum', 'ret', 5)}) reversal_5,
 {roll('stddev_samp', 'ret', 63)} vol_63, {roll('stddev_samp', 'ret', 21)} vol_21, close / ({roll('max', 'close', 252, 120)}) dist_52w_high, {_AMIHUD} amihud, {_SHOCK} volume_shock,
 case when count(case when ret is not null and mkt is not null then 1 end) {_BETA} >= 63 then covar_samp(ret, mkt) {_BETA} end cv, case when count(mkt) {_BETA} >= 63 then var_samp(mkt) {_BETA} end vm,
 {', '.join(f'ln({ahead(h)} / close) fwd_{h}' for h in (21, 63, 126, 252))} from pm),
features as (select *, vol_21 / nullif(vol_63, 0) vol_ratio, cv / nullif(vm, 0) beta_63 from fe0)"""


def rank_sql(x: str, by: str) -> str:
    return f"rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0::double"


IC_CTE = f"""icr as (select date, {rank_sql('mom_63', 'date')} ra, {rank_sql('fwd_21', 'date')} rb from features where mom_63 is not null and fwd_21 is not null),
ic as (select date, count(*) n, case when stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then corr(ra, rb) end rho from icr group by date having count(*) >= 8)"""


def rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::double {c}" for c in columns)


def normal_cdf(z: str) -> str:
    """P(Z <= z) by Simpson's rule on the density between 0 and |z| (4,000 steps up to 12), apart from the library's series and fractions."""
    step = f"(least(abs({z}), 12.0) / 4000)"
    simpson = f"list_sum(list_transform(range(4001), lambda i: case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end * exp(-(i * {step}) * (i * {step}) / 2)))"
    return f"(0.5 + sign({z}) * {step} / 3 * {simpson} / sqrt(2 * pi()))"


def luck_in_numbers(trials: int) -> float:
    """The bar for the best of so many trials, in standard deviations, by Python's own inverse normal."""
    z, g = NormalDist().inv_cdf, 0.5772156649
    return (1 - g) * z(1 - 1 / trials) + g * z(1 - 1 / (trials * e))


def q(body: str, *ctes: str) -> str:
    """The whole text; each common table expression that begins a line is computed once. Those with a list of columns after their name may be recursive."""
    text = re.sub(r"(?m)^(with )?(\w+) as \(", r"\1\2 as materialized (", ",\n".join([base(), *ctes])) + "\n" + body
    return text.replace("with ", "with recursive ", 1) if re.search(r"(?m)^\w+\([\w, ]+\) as \(", text) else text


__all__ = ["FEATURES", "NAMES", "q", "rounded"]
