"""Queries of return-series analytics, with their oracle SQL."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import linear
from ..operators import analytics as an
from ..operators.modelling import finite_series
from ..sources import ingest, panel
from . import sql as S

Q, SQL = {}, {}
BENCH = "AMERICA"


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def returns(spark, d):
    """Returns behind the finiteness gate: no statistic is computed of a series that is not finite throughout. Written once: statistics read them several times."""
    return ingest.written(finite_series(panel.close_returns(panel.daily_bars(spark, d)), "ret"), "returns")


R = S.RETURNS
# Growth by plain products is not in SQL, so the logs of all factors here are sums, too; no return reaches -1.
DD = f"""{R}, g as (select *, exp(sum(ln(1 + ret)) over w) as equity, row_number() over w as idx from returns window w as (partition by strategy order by session)),
dd as (select *, max(equity) over w as peak, equity / max(equity) over w - 1 as dd from g window w as (partition by strategy order by session rows unbounded preceding))"""


@query(f"{R} select strategy, session, ret from returns")
def close_returns(spark, d):
    return returns(spark, d)


@query(f"""{S.BARS}, e as (select symbol as strategy, session, close * 1000 as equity from bars)
select strategy, session, round(case when b <= 0 then 0.0 else equity / b - 1 end, 10) as ret from (select *, lag(equity, 1, 1000000.0) over (partition by strategy order by session) as b from e)""")
def equity_returns(spark, d):
    e = ingest.written(panel.daily_bars(spark, d).select(F.col("symbol").alias("strategy"), "session", (F.col("close") * 1000).alias("equity")), "equity")
    return an.equity_returns(e, 1e6)


@query(f"{DD} select strategy, session, round(equity, 8) as equity from dd")
def growth_curve(spark, d):
    return an.growth_curve(returns(spark, d)).select("strategy", "session", F.round("equity", 8).alias("equity"))


@query(f"{R} select strategy, round(pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1, 8) as annualized_return from returns group by strategy")
def annualized_return(spark, d):
    x = returns(spark, d).groupBy("strategy").agg(an.product(1 + F.col("ret")).alias("g"), F.count("*").alias("n"))
    return x.select("strategy", F.round(an.annualized_return(F.col("g"), F.col("n")), 8).alias("annualized_return"))


@query(f"{R} select strategy, round(avg(ret) / stddev_samp(ret), 10) as sharpe, count(*) as n from returns group by strategy")
def period_sharpe(spark, d):
    return an.period_sharpe(returns(spark, d)).withColumn("sharpe", F.round("sharpe", 10))


@query(f"{R} select a.strategy, a.session, a.ret as r, b.ret as b from returns a join returns b on a.session = b.session and b.strategy = '{BENCH}' where a.strategy <> '{BENCH}'")
def aligned_returns(spark, d):
    return _pairs(spark, d)


def _pairs(spark, d):
    r = returns(spark, d)
    return an.aligned(r.where(F.col("strategy") != BENCH), r.where(F.col("strategy") == BENCH))


@query(f"{DD} select strategy, session, round(dd, 8) as dd from dd")
def drawdown_series(spark, d):
    return an.drawdowns(returns(spark, d)).select("strategy", "session", F.round("dd", 8).alias("dd"))


DURATION = """u as (select *, sum(case when dd >= -1e-12 then 1 else 0 end) over (partition by strategy order by session) as island from dd),
dur as (select strategy, max(n) as max_drawdown_duration from (select strategy, island, count(*) filter (where dd < -1e-12) as n from u group by all) group by strategy),
tr as (select strategy, arg_min(idx, row(round(dd, 12), idx)) as ti, arg_min(peak, row(round(dd, 12), idx)) as tp from dd group by strategy),
rec as (select tr.strategy, min(case when dd.idx > ti and equity >= tp * (1 - 1e-12) then dd.idx end) - min(ti) as time_to_recovery from tr join dd using (strategy) group by tr.strategy)"""


@query(f"{DD}, {DURATION} select * from dur")
def drawdown_duration(spark, d):
    return an.drawdown_duration(an.drawdowns(returns(spark, d)))


@query(f"{DD}, {DURATION} select * from rec")
def time_to_recovery(spark, d):
    return an.time_to_recovery(an.drawdowns(returns(spark, d)))


def _q(level):
    return f"select strategy, quantile_cont(ret, {round(1 - level, 10)}) as q from returns group by strategy"


@query(f"{R} select strategy, round(greatest(0.0, -quantile_cont(ret, 0.05)), 10) as var_95, round(greatest(0.0, -quantile_cont(ret, 0.01)), 10) as var_99 from returns group by strategy")
def historical_var(spark, d):
    r = returns(spark, d)
    a, b = (an.var_cvar(r, x).select("strategy", F.col("var").alias(n)) for x, n in ((0.95, "var_95"), (0.99, "var_99")))
    return a.join(b, "strategy")


@query(f"{R}, q as ({_q(0.95)}) select strategy, round(greatest(0.0, -avg(ret)), 10) as cvar from returns join q using (strategy) where ret <= q group by strategy")
def historical_cvar(spark, d):
    return an.var_cvar(returns(spark, d), 0.95).select("strategy", "cvar")


_Z = NormalDist().inv_cdf(0.05)
_CF = f"""cf as (select strategy, round(greatest(0.0, -(m + ({_Z} + {_Z**2 - 1} * s / 6 + {_Z**3 - 3 * _Z} * k / 24 - {2 * _Z**3 - 5 * _Z} * s * s / 36) * sd)), 10) as cornish_fisher_var
from (select strategy, avg(ret) m, stddev_samp(ret) sd, skewness(ret) s, kurtosis(ret) k from returns group by strategy))"""


@query(f"{R}, {_CF} select * from cf")
def cornish_fisher_var(spark, d):
    return an.cornish_fisher(returns(spark, d))


@query(f"{R} select strategy, count(*) as n, round(skewness(ret), 8) as skew, round(kurtosis(ret), 8) as kurt from returns group by strategy")
def sample_moments(spark, d):
    return an.moments(returns(spark, d)).select("strategy", "n", F.round("skew", 8).alias("skew"), F.round("kurt", 8).alias("kurt"))


@query(f"""{R} select strategy, session, case when count(ret) over w = 126 then round(avg(ret) over w / stddev_samp(ret) over w * sqrt(252), 6) end as rolling_sharpe
from returns window w as (partition by strategy order by session rows between 125 preceding and current row)""")
def rolling_sharpe(spark, d):
    return an.rolling_sharpe(returns(spark, d)).select("strategy", "session", F.round("rolling_sharpe", 6).alias("rolling_sharpe"))


@query(f"""{R}, s as (select strategy, min(ret) lo, (max(ret) - min(ret)) / 41 as width from returns group by strategy),
n as (select strategy, least(floor((ret - lo) / width), 40)::int as bin, count(*) as n from returns join s using (strategy) group by all)
select s.strategy, b::int as bin, round(lo + (b + 0.5) * width, 8) as centre, coalesce(n.n, 0) as n from s cross join range(41) t(b) left join n on n.strategy = s.strategy and n.bin = b""")
def return_histogram(spark, d):
    return an.histogram(returns(spark, d))


@query(f"{R} select strategy, year(session)::int as year, month(session)::int as month, round(exp(sum(ln(1 + ret))) - 1, 8) as ret from returns group by all")
def monthly_returns(spark, d):
    return an.compounded(returns(spark, d), "year", "month").withColumn("ret", F.round("ret", 8))


@query(f"""{R}, y as (select strategy, year(session)::int as year, exp(sum(ln(1 + ret))) - 1 as ret from returns group by all)
select a.strategy, a.year, round(a.ret, 8) as ret, round(coalesce(b.ret, 0.0), 8) as benchmark from y a left join y b on a.year = b.year and b.strategy = '{BENCH}' where a.strategy <> '{BENCH}'""")
def yearly_returns(spark, d):
    y = an.compounded(returns(spark, d), "year")
    b = y.where(F.col("strategy") == BENCH).select("year", F.col("ret").alias("benchmark"))
    return y.where(F.col("strategy") != BENCH).join(b, "year", "left").select("strategy", "year", F.round("ret", 8).alias("ret"), F.round(F.coalesce("benchmark", F.lit(0.0)), 8).alias("benchmark"))


SUMMARY = f"""{DD}, {DURATION}, {_CF}, q5 as ({_q(0.95)}), q1 as ({_q(0.99)}),
tails as (select r.strategy, greatest(0.0, -any_value(q5.q)) v95, greatest(0.0, -avg(case when ret <= q5.q then ret end)) c95, greatest(0.0, -any_value(q1.q)) v99, greatest(0.0, -avg(case when ret <= q1.q then ret end)) c99
  from returns r join q5 using (strategy) join q1 using (strategy) group by r.strategy),
agg as (select strategy, count(*) n, pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1 as ann, avg(ret) m, stddev_samp(ret) sd, sqrt(avg(pow(least(ret, 0.0), 2))) down, min(dd) mdd, max(ret) hi, min(ret) lo, avg(case when ret > 0 then 1.0 else 0.0 end) pos, skewness(ret) sk, kurtosis(ret) ku from dd group by strategy)
select strategy, n as n_sessions, round(ann, 8) as annualized_return, round(sd * sqrt(252), 8) as annualized_volatility, round(m / sd * sqrt(252), 8) as sharpe, round(m / down * sqrt(252), 8) as sortino, round(ann / abs(mdd), 8) as calmar,
  round(mdd, 8) as max_drawdown, hi as best_day, lo as worst_day, round(pos, 8) as positive_fraction, max_drawdown_duration, time_to_recovery, round(sk, 8) as skewness, round(ku, 8) as excess_kurtosis,
  round(v95, 8) as var_95, round(c95, 8) as cvar_95, round(v99, 8) as var_99, round(c99, 8) as cvar_99, round(cornish_fisher_var, 8) as cornish_fisher_var_95
from agg join dur using (strategy) join rec using (strategy) join tails using (strategy) join cf using (strategy)"""


@query(SUMMARY)
def performance_summary(spark, d):
    x = an.performance_summary(returns(spark, d))
    return x.select(*[F.round(c, 8).alias(c) if t == "double" and c not in ("best_day", "worst_day") else F.col(c) for c, t in x.dtypes])


_P = f"{R}, pr as (select a.strategy, a.ret as r, b.ret as b from returns a join returns b on a.session = b.session and b.strategy = '{BENCH}' where a.strategy <> '{BENCH}')"


@query(f"""{_P}, x as (select strategy, count(*) n, regr_slope(r, b) beta, regr_intercept(r, b) a, regr_sxx(r, b) sxx, regr_syy(r, b) syy, regr_sxy(r, b) sxy, avg(b) mb, corr(r, b) c, stddev_samp(r - b) sd, avg(r - b) act from pr group by strategy)
select strategy, n as n_sessions, round(beta, 8) as beta, round(a * 252, 8) as alpha_annualized, round(a / sqrt((syy - beta * sxy) / (n - 2) * (1.0 / n + mb * mb / sxx)), 6) as alpha_tstat, round(c, 8) as correlation, round(c * c, 8) as r_squared,
  round(sd * sqrt(252), 8) as tracking_error, round(act * 252 / (sd * sqrt(252)), 8) as information_ratio from x where n >= 3""")
def benchmark_stats(spark, d):
    return an.benchmark_stats(_pairs(spark, d))


@query()
def benchmark_pvalues(spark, d):
    """Two-sided p-values of the alphas: one row for each strategy reaches the finaliser."""
    return linear.with_pvalue(an.benchmark_stats(_pairs(spark, d)), "alpha_tstat", F.col("n_sessions") - 2, "alpha_pvalue").select("strategy", "alpha_tstat", F.round("alpha_pvalue", 8).alias("alpha_pvalue"))


@query(f"""{_P} select strategy, round(avg(r) filter (where b > 0) / avg(b) filter (where b > 0), 8) as up_capture, round(avg(r) filter (where b < 0) / avg(b) filter (where b < 0), 8) as down_capture from pr group by strategy""")
def capture_ratios(spark, d):
    return an.capture_ratios(_pairs(spark, d))


@query()
def factor_attribution(spark, d):
    """Each supplier nation's weekly returns on those of the five regions."""
    weekly = panel.close_returns(panel.weekly_bars(spark, d))
    factors = weekly.groupBy("session").pivot("strategy", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).agg(F.first("ret")).dropna()
    t = panel.table
    n = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    bars = panel.bars_of(n.select(F.col("n_name").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("session"), (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("price"), F.col("l_quantity").alias("qty"), *panel.ORDER))
    return linear.attribution(panel.close_returns(bars).join(factors, "session"), "strategy", "ret", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


def _psr(threshold: str) -> str:
    """CTEs up to ``pr``: the probabilistic Sharpe ratio at a threshold; the normal's density is integrated by Simpson's rule in 2,000 steps."""
    return f"""{R}, mo as (select strategy, count(*) n, avg(ret) / stddev_samp(ret) as sr, skewness(ret) s, kurtosis(ret) k from returns group by strategy), th as ({threshold}),
z as (select *, (sr - sr0) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - s * sr + (k + 2) / 4 * sr * sr)) as z from mo cross join th),
ph as (select *, 0.5 + z / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(z * i / 2000.0, 2) / 2))) as phi from z),
pr as (select strategy, round(sr, 8) as sharpe, round(sr0, 8) as threshold, round(case when n < 3 then 0.0 else phi end, 10) as psr from ph)"""


@query(f"{_psr('select 0.0::double as sr0')} select * from pr")
def psr(spark, d):
    return an.psr(returns(spark, d))


_INV = NormalDist().inv_cdf
_BEST = 0.42278433509846713 * _INV(1 - 1 / 5) + 0.5772156649015329 * _INV(1 - 1 / (5 * 2.718281828459045))  # of five trials
_DSR = _psr(f"select stddev_samp(sr) * {_BEST} as sr0 from mo")


@query(f"{_DSR} select strategy, sharpe, threshold, psr as dsr from pr")
def deflated_sharpe(spark, d):
    return an.deflated_sharpe(returns(spark, d))


_HALVES = ", ".join(f"({c}, {b}, {str(b in half).lower()})" for c, half in enumerate(combinations(range(10), 5)) for b in range(10))


_PBO = f"""o as (select *, row_number() over (partition by strategy order by session) - 1 as i, count(*) over (partition by strategy) as t from returns),
bl as (select strategy, ret, (case when i < (t % 10) * (t // 10 + 1) then i // (t // 10 + 1) else t % 10 + (i - (t % 10) * (t // 10 + 1)) // (t // 10) end)::int as block from o),
m as (select strategy, block, count(*) n, sum(ret) s, sum(ret * ret) q from bl group by all),
x as (select combo, strategy, inside, sum(n) n, sum(s) s, sum(q) q from m join (values {_HALVES}) c(combo, block, inside) using (block) group by all),
p as (select combo, strategy, inside, case when (q - s * s / n) / (n - 1) > 1e-18 then s / n / sqrt((q - s * s / n) / (n - 1)) else 0.0 end as perf from x),
b as (select combo, strategy, max(perf) filter (where inside) as i, max(perf) filter (where not inside) as o from p group by all),
r as (select *, row_number() over (partition by combo order by i desc, strategy) as first, rank() over (partition by combo order by o) + (count(*) over (partition by combo, o) - 1) / 2.0 as rk, count(*) over (partition by combo) as nt from b),
pl as (select combo::int as combo, strategy as winner, round(ln((rk / (nt + 1)) / (1 - rk / (nt + 1))), 8) as logit from r where first = 1)"""


@query(f"{R}, {_PBO} select * from pl")
def pbo_logits(spark, d):
    return an.pbo_logits(returns(spark, d))


@query(f"""{R}, {_PBO}, sp as (select min(logit) lo, (max(logit) - min(logit)) / 21 as width from pl), n as (select least(floor((logit - lo) / width), 20)::int as bin, count(*) as n from pl, sp group by 1)
select b::int as bin, round(lo + (b + 0.5) * width, 4) as centre, coalesce(n.n, 0) as n from sp cross join range(21) t(b) left join n on n.bin = b""")
def logit_histogram(spark, d):
    """The logits of all combinations in 21 bins."""
    return an.logit_histogram(ingest.written(an.pbo_logits(returns(spark, d)), "logits"))


@query(f"""{_DSR}, {_PBO}, su as (select count(*) as combinations, round(avg(case when logit <= 0 then 1.0 else 0.0 end), 8) as pbo, round(quantile_cont(logit, 0.5), 8) as logit_median from pl)
select combinations, pbo, logit_median, strategy, sharpe, threshold, psr as dsr from su cross join (select * from pr order by sharpe desc, strategy limit 1)""")
def overfitting_summary(spark, d):
    return an.overfitting_summary(returns(spark, d)).withColumns({c: F.round(c, 8) for c in ("pbo", "logit_median")})


@query(f"""{DD} select strategy, session, round(equity, 8) as equity from (select *, count(*) over (partition by strategy) as n from dd) where (idx - 1) % ceil(n / 320.0)::int = 0 or idx = n""")
def downsample_curve(spark, d):
    return an.downsample(an.growth_curve(returns(spark, d)).select("strategy", "session", F.round("equity", 8).alias("equity")))
