"""Queries of walk-forward models, targets, ledgers and replays, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import linear
from ..operators import analytics as an
from ..operators import features as feat
from ..operators import modelling as mod
from ..operators import replay as rep
from ..operators import targets as tgt
from ..sources import digests, ingest, panel
from . import sql as S

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def rect(spark, d):
    """The panel, written once: later stages read it several times."""
    return ingest.written(panel.rectangular(ingest.written(panel.daily_bars(spark, d), "bars")), "panel")


def rows(spark, d, r=None):
    """Feature rows of the panel ``r``, written once."""
    return ingest.written(feat.feature_rows(rect(spark, d) if r is None else r, "rect"), "features")


RECT = S.BARS.replace("bars as (", "bars0 as (") + ", bars as (select * from bars0 where session in (select session from bars0 group by session having count(*) = (select count(distinct symbol) from bars0)))"
FEATS = S.FEATURES.replace(S.BARS, RECT)
CALENDAR = "cal as (select session, row_number() over (order by session) as i from (select distinct decision_session as session from features)), dec as (select a.session as decision_session, b.session as embargo_start from cal a left join cal b on b.i = a.i - 20)"
USABLE = "us as (select * from features where not missing and forward_return_21 is not null and label_end_session is not null)"


@query(f"""{FEATS}, {CALENDAR}, {USABLE} select dec.decision_session, us.symbol, count(*) as training_rows, min(us.decision_session) as training_start, max(us.decision_session) as training_end from dec join us on label_end_session < embargo_start group by dec.decision_session, us.symbol""")
def training_split(spark, d):
    """The split of every decision by symbol."""
    return mod.training_split(rows(spark, d))


@query()
def training_membership(spark, d):
    """The split of every decision, told by row: the first decision that each training row serves."""
    return mod.training_membership(rows(spark, d))


_SUFF = f"""{FEATS}, {CALENDAR}, {USABLE}, fs as (select decision_session as s, min(label_end_session) as e from us group by 1),
suff as (select dec.decision_session, dec.embargo_start, count(fs.s) as training_sessions from dec left join fs on fs.e < dec.embargo_start group by all)"""


@query(f"{_SUFF} select decision_session, training_sessions, case when training_sessions >= 504 then 'ok' else 'blocked' end as status from suff")
def training_sufficiency(spark, d):
    return mod.sufficiency(rows(spark, d))


@query(f"""{_SUFF}, b as (select dec.decision_session, min(us.decision_session) as training_start, max(us.decision_session) as training_end, count(us.symbol) as training_rows from dec left join us on us.label_end_session < dec.embargo_start group by 1)
select suff.decision_session, embargo_start, training_start, training_end, training_rows, training_sessions, case when training_sessions < 504 then 'insufficient_training_sessions' end as blocked_reason from suff join b using (decision_session)""")
def forecast_batches(spark, d):
    return mod.forecast_batches(rows(spark, d))


def _alphas(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values], "alpha double")


def _scores(spark, d):
    return ingest.written(feat.xs_zscore(rows(spark, d).where("not missing")), "scores")


def _coefficients(spark, z, alphas=(1.0, 10.0, 100.0)):
    return mod.ridge_coefficients(z, _alphas(spark, *alphas))


_FEATURES = feat.FEATURES
_SUMS = ", ".join([f"round(sum(z{i} * forward_return_21), 6) as zy_{i}" for i in range(6)] + [f"round(sum(z{i} * z{j}), 5) as zz_{i}_{j}" for i in range(6) for j in range(i, 6)])


@query(f"""{S.FEATURES}, {CALENDAR}, {USABLE}, seen as (select dec.decision_session as d, us.* from dec join us on label_end_session < embargo_start),
scored as (select d, forward_return_21, {', '.join(f'case when stddev_samp({c}) over w > 1e-12 then ({c} - avg({c}) over w) / stddev_samp({c}) over w else 0.0 end as z{i}' for i, c in enumerate(_FEATURES))} from seen window w as (partition by d, decision_session))
select d as decision_session, count(*) as n, round(sum(forward_return_21), 8) as y, {_SUMS} from scored group by d""")
def ridge_sums(spark, d):
    """What every decision's fits are solved from, on a panel with gaps: its training rows, their labels and products of z-scores among the rows that it may see."""
    g = mod.decision_sums(ingest.written(feat.feature_rows(ingest.written(panel.daily_bars(spark, d), "bars"), "daily"), "features"))
    at = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(8) for j in range(i, 8))}
    return g.select(
        "decision_session", F.round(F.col("g")[0]).cast("long").alias("n"), F.round(F.col("g")[at[0, 7]], 8).alias("y"), *[F.round(F.col("g")[at[i + 1, 7]], 6).alias(f"zy_{i}") for i in range(6)],
        *[F.round(F.col("g")[at[i + 1, j + 1]], 5).alias(f"zz_{i}_{j}") for i in range(6) for j in range(i, 6)],
    )


@query()
def ridge_coefficients(spark, d):
    return _coefficients(spark, _scores(spark, d))


@query()
def forecasts(spark, d):
    z = _scores(spark, d)
    return mod.forecasts(z, _coefficients(spark, z))


@query(f"{S.BARS}, s as (select session, row_number() over (order by session) as i, lead(session) over (order by session) as x from (select distinct session from bars)) select session as decision_session, x as execution_session, (i - 601) % 21 = 0 as retrain from s where i > 600 and x is not null")
def decision_schedule(spark, d):
    return mod.schedule(panel.daily_bars(spark, d).select("session").distinct(), 600, 21)


# --- targets: the last 21 sessions' return stands for the forecast where SQL has to follow

SIGNALS = f"""{FEATS}, sig as (select decision_session, symbol, return_21 as forecast, volatility_21 as vol from features where not missing),
qual as (select * from sig where forecast > 0 and vol > 0), des as (select *, 0.95 * (forecast / vol) / sum(forecast / vol) over (partition by decision_session) as desired from qual)"""
KEY = ("decision_session",)


def _signals(spark, d, r=None):
    return rows(spark, d, r).where("not missing").select("decision_session", "symbol", F.col("return_21").alias("forecast"), F.col("volatility_21").alias("vol"))


@query(f"{SIGNALS} select * from qual")
def qualified_signals(spark, d):
    return tgt.qualified(_signals(spark, d))


@query(f"{SIGNALS} select decision_session, symbol, round(desired, 8) as desired from des")
def desired_weights(spark, d):
    return tgt.desired(_signals(spark, d), KEY).select("decision_session", "symbol", F.round("desired", 8).alias("desired"))


@query()
def target_weights(spark, d):
    z = _scores(spark, d)
    f = mod.forecasts(z, _coefficients(spark, z))
    vol = z.select("decision_session", "symbol", F.col("volatility_21").alias("vol"))
    return tgt.quantised(tgt.constrained(tgt.desired(f.join(vol, ["decision_session", "symbol"]))))


@query()
def target_cash(spark, d):
    s = _signals(spark, d)
    return tgt.cash(tgt.quantised(tgt.constrained(tgt.desired(s, KEY), KEY)), s, KEY)


@query(f"""{SIGNALS} select decision_session as session, des.symbol, floor(1000000.0 * round(desired, 6) / close)::bigint as shares from des join bars on bars.symbol = des.symbol and bars.session = des.decision_session where floor(1000000.0 * round(desired, 6) / close) > 0""")
def target_shares(spark, d):
    w = tgt.desired(_signals(spark, d), KEY).select(F.col("decision_session").alias("session"), "symbol", F.round("desired", 6).alias("weight"))
    prices = panel.daily_bars(spark, d).select("symbol", "session", F.col("close").alias("price"))
    return tgt.shares(w, prices, 1e6).select("session", "symbol", "shares")


@query(f"""{SIGNALS} select decision_session as session, case symbol when 'ASIA' then 'Emerging' when 'AMERICA' then 'Developed' when 'EUROPE' then 'Developed' else 'Other' end as asset_class, round(sum(round(desired, 8)), 6) as weight from des group by all""")
def asset_class_weights(spark, d):
    w = tgt.desired(_signals(spark, d), KEY).select(F.col("decision_session").alias("session"), "symbol", F.round("desired", 8).alias("weight"))
    classes = spark.createDataFrame([("ASIA", "Emerging"), ("AMERICA", "Developed"), ("EUROPE", "Developed")], "symbol string, asset_class string")
    return tgt.composition(w, classes).withColumn("weight", F.round("weight", 6))


@query()
def held_weights(spark, d):
    r = rect(spark, d)
    retrain = mod.schedule(r.select("session").distinct(), 600, 21).where("retrain").select("decision_session")
    w = tgt.quantised(tgt.constrained(tgt.desired(_signals(spark, d, r).join(retrain, "decision_session", "left_semi"), KEY), KEY))
    return mod.held_weights(r.select("session"), w)


# --- ledgers

_FILLS = """fl as (select o_custkey as account, p_brand as symbol, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, case when l_returnflag = 'R' then -l_quantity else l_quantity end::int as qty, round(p_retailprice * (1 - l_discount), 4) as price
  from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey)"""
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_extendedprice")


def _fills(spark, d):
    t = panel.table
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int")
    return x.select(F.col("o_custkey").alias("account"), F.col("p_brand").alias("symbol"), qty.alias("qty"), F.round(F.col("p_retailprice") * (1 - F.col("l_discount")), 4).alias("price"), *ORDER)


@query(f"""with {_FILLS}, a as (select account, symbol, sum(qty) as qty from fl where l_orderkey % 2 = 0 group by all), b as (select account, symbol, sum(qty) as qty from fl where l_orderkey % 2 = 1 group by all)
select coalesce(a.account, b.account) as account, coalesce(a.symbol, b.symbol) as symbol, (coalesce(a.qty, 0) - coalesce(b.qty, 0))::bigint as qty from a full join b on a.account = b.account and a.symbol = b.symbol where coalesce(a.qty, 0) <> coalesce(b.qty, 0)""")
def rebalance_fills(spark, d):
    h = lambda k: _fills(spark, d).where(f"l_orderkey % 2 = {k}").groupBy("account", "symbol").agg(F.sum("qty").alias("qty"))
    return rep.rebalance_fills(h(0), h(1))


_LEDGER = f"""with {_FILLS}, lg as (select *, sum(qty) over (partition by account, symbol order by {', '.join(ORDER)} rows unbounded preceding) as position,
 1000000 - sum(qty::decimal(12,0) * price::decimal(18,4) + (abs(qty::decimal(12,0) * price::decimal(18,4)) * 0.0005::decimal(5,4))) over (partition by account order by {', '.join(ORDER)} rows unbounded preceding) as cash,
 sum((abs(qty::decimal(12,0) * price::decimal(18,4)) * 0.0005::decimal(5,4))) over (partition by account order by {', '.join(ORDER)} rows unbounded preceding) as total_costs from fl)"""


@query(f"{_LEDGER} select account, symbol, l_orderkey, l_linenumber, l_partkey, qty, position::bigint as position, round(cash::double, 8) as cash, round(total_costs::double, 8) as total_costs from lg")
def fill_ledger(spark, d):
    x = rep.fill_ledger(_fills(spark, d), "1000000", "5", ORDER)
    return x.select("account", "symbol", "l_orderkey", "l_linenumber", "l_partkey", "qty", "position", F.round(F.col("cash").cast("double"), 8).alias("cash"), F.round(F.col("total_costs").cast("double"), 8).alias("total_costs"))


@query(f"""{_LEDGER}, lp as (select account, symbol, last(position order by {', '.join(ORDER)}) as position from lg group by all), ca as (select account, last(cash order by {', '.join(ORDER)}) as cash from lg group by all),
cl as (select p_brand as symbol, round(avg(p_retailprice), 2) as close from part where p_brand <> 'Brand#11' group by all),
v as (select account, sum(position * close) as value, count(*) filter (where close is null) as unpriced from lp left join cl using (symbol) where position <> 0 group by all)
select account, round(cash::double, 8) as cash, round(coalesce(value, 0.0), 2) as value, round(cash::double + coalesce(value, 0.0), 2) as equity, coalesce(unpriced, 0)::bigint as unpriced from ca left join v using (account)""")
def mark_to_market(spark, d):
    closes = panel.table(spark, d, "part").where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("symbol")).agg(F.round(F.avg("p_retailprice"), 2).alias("close"))
    x = rep.mark_to_market(rep.fill_ledger(_fills(spark, d), "1000000", "5", ORDER), closes, ORDER)
    return x.select("account", F.round(F.col("cash").cast("double"), 8).alias("cash"), F.round("value", 2).alias("value"), F.round("equity", 2).alias("equity"), "unpriced")


@query(f"""{S.BARS} select session, max(close) filter (where symbol = 'AFRICA') as "AFRICA", max(close) filter (where symbol = 'AMERICA') as "AMERICA", max(close) filter (where symbol = 'ASIA') as "ASIA", max(close) filter (where symbol = 'EUROPE') as "EUROPE", max(close) filter (where symbol = 'MIDDLE EAST') as "MIDDLE EAST" from bars group by session""")
def price_matrix(spark, d):
    return rep.price_matrix(panel.daily_bars(spark, d), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


# --- replays

_GRID = f"""{SIGNALS}, ex as (select decision_session, lead(decision_session) over (order by decision_session) as session from (select distinct decision_session from sig)),
grid as (select ex.session, sig.symbol, least(coalesce(round(desired, 8), 0.0), 0.25) as weight from ex join sig using (decision_session) left join des on des.decision_session = sig.decision_session and des.symbol = sig.symbol where ex.session is not null),
both_ as (select 'signal' as strategy, * from grid union all select 'equal' as strategy, session, symbol, 0.95 / 5 as weight from grid)"""
_REPLAY = f"""{_GRID}, x0 as (select strategy, session, b.symbol, weight, open, close, lag(weight) over p as w0, lag(open) over p as o0 from both_ b join bars using (symbol, session) window p as (partition by strategy, b.symbol order by session)),
x1 as (select *, coalesce(w0 * open / o0, 0.0) as moved from x0), x2 as (select *, 1 - sum(coalesce(w0, 0.0)) over s + sum(moved) over s as den from x1 window s as (partition by strategy, session)),
fr as (select strategy, session, sum(weight) as w, any_value(den) as den, sum(abs(weight - moved / den)) as turn, sum(weight * close / open) as intraday from x2 group by all),
y0 as (select *, bps / 1e4 * turn as k, 1 - w - bps / 1e4 * turn + intraday as cl from fr cross join (values (2.0), (5.0), (10.0)) c(bps)),
y1 as (select *, coalesce((den - lag(k) over p) / lag(cl) over p, 1.0) as gap from y0 window p as (partition by strategy, bps order by session)),
y2 as (select *, exp(sum(ln(gap * cl)) over (partition by strategy, bps order by session)) as growth from y1),
rp as (select strategy, bps::double as cost_bps, session, 1e6 * growth as equity, gap * cl - 1 as ret, turn * gap as turnover, k * gap * growth / (gap * cl) * 1e6 as cost, gap * cl > 1 as hit from y2)"""


def _grid(spark, d, r):
    sig = _signals(spark, d, r)
    ex = sig.select("decision_session").distinct().withColumn("session", F.lead("decision_session").over(Window.orderBy("decision_session"))).where("session is not null")
    des = tgt.desired(sig, KEY).select("decision_session", "symbol", F.round("desired", 8).alias("desired"))
    grid = sig.select("decision_session", "symbol").join(ex, "decision_session").join(des, ["decision_session", "symbol"], "left")
    return grid.select("session", "symbol", F.least(F.coalesce("desired", F.lit(0.0)), F.lit(0.25)).alias("weight"))


def _replay(spark, d, names=("signal", "equal"), levels=(2.0, 5.0, 10.0)):
    r = rect(spark, d)
    g = _grid(spark, d, r)
    kinds = {"signal": g.withColumn("strategy", F.lit("signal")), "equal": g.withColumn("weight", F.lit(0.95 / 5)).withColumn("strategy", F.lit("equal"))}
    w = kinds[names[0]]
    for n in names[1:]:
        w = w.unionByName(kinds[n])
    costs = spark.createDataFrame([(c,) for c in levels], "cost_bps double")
    return rep.replay(rep.cost_free(w, r), costs)


_ROUND = "round(equity, 4) as equity, round(ret, 8) as ret, round(turnover, 8) as turnover, round(cost, 4) as cost"


def _rounded(df, *keys):
    return df.select(*keys, F.round("equity", 4).alias("equity"), F.round("ret", 8).alias("ret"), F.round("turnover", 8).alias("turnover"), F.round("cost", 4).alias("cost"))


@query(f"{_REPLAY} select session, {_ROUND} from rp where strategy = 'signal' and cost_bps = 5")
def weights_backtest(spark, d):
    return _rounded(_replay(spark, d, ("signal",), (5.0,)), "session")


@query(f"{_REPLAY} select strategy, cost_bps, session, {_ROUND} from rp where strategy = 'signal'")
def cost_sensitivity(spark, d):
    return _rounded(_replay(spark, d, ("signal",)), "strategy", "cost_bps", "session")


@query(f"{_REPLAY} select session, {_ROUND} from rp where strategy = 'equal' and cost_bps = 5")
def equal_weight(spark, d):
    return _rounded(_replay(spark, d, ("equal",), (5.0,)), "session")


@query(f"{_REPLAY} select session, round(equity, 4) as equity from rp where strategy = 'signal' and cost_bps = 2")
def equity_curve(spark, d):
    return _replay(spark, d, ("signal",), (2.0,)).select("session", F.round("equity", 4).alias("equity"))


@query(f"{S.BARS} select symbol, round(arg_max(close, session) / arg_min(close, session) - 1, 8) as contribution from bars where session between date '1996-01-01' and date '1999-12-31' group by symbol")
def symbol_contribution(spark, d):
    return rep.contribution(panel.daily_bars(spark, d), "1996-01-01", "1999-12-31").withColumn("contribution", F.round("contribution", 8))


def _metrics_sql(keys: str, source: str) -> str:
    return f"""m0 as (select *, first_value(equity / (1 + ret)) over p as start from {source} window p as (partition by {keys} order by session)),
m1 as (select *, greatest(start, max(equity) over (partition by {keys} order by session rows unbounded preceding)) as peak from m0),
m2 as (select {keys}, count(*) as n, min(session) as start_session, max(session) as end_session, any_value(start) as start, arg_max(equity, session) as final, stddev_samp(ret) * sqrt(252) as vol, least(0.0, min(equity / peak - 1)) as mdd, avg(case when hit then 1.0 else 0.0 end) as hr, avg(turnover) as tu, sum(cost) as tc from m1 group by {keys}),
mt as (select {keys}, n, start_session, end_session, round(pow(final / start, 252.0 / n) - 1, 8) as annualized_return, round(vol, 8) as annualized_volatility, round((pow(final / start, 252.0 / n) - 1) / vol, 8) as sharpe, round(mdd, 8) as max_drawdown, round(tc, 4) as total_costs, round(tu, 8) as turnover, round(hr, 8) as hit_rate from m2)"""


@query(f"{_REPLAY}, {_metrics_sql('strategy, cost_bps', 'rp')} select * from mt")
def backtest_metrics(spark, d):
    return rep.metrics(_replay(spark, d), ("strategy", "cost_bps"))


@query(f"{_REPLAY}, bk as (select *, ((row_number() over (partition by strategy, cost_bps order by session) - 1) // 63)::int as block from rp), {_metrics_sql('strategy, cost_bps, block', 'bk')} select * from mt where n >= 63")
def evaluation_windows(spark, d):
    return rep.windows(_replay(spark, d), ("strategy", "cost_bps"), 63)


# The penalties of the trials.
GRID = (0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


@query()
def alpha_trials(spark, d):
    """A return series for each ridge penalty: coefficients every 21 sessions, held in between, replayed at 5 bps."""
    r = rect(spark, d)
    z = ingest.written(feat.xs_zscore(feat.feature_rows(r, "rect").where("not missing")), "scores")
    c = mod.ridge_coefficients(z, _alphas(spark, *GRID), 21)
    # Each session uses the latest coefficients: a running value on one row a session and penalty.
    days = z.select("decision_session").distinct().crossJoin(F.broadcast(_alphas(spark, *GRID)))
    w = Window.partitionBy("alpha").orderBy("decision_session").rowsBetween(Window.unboundedPreceding, 0)
    latest = days.join(c, ["decision_session", "alpha"], "left").withColumn("s", F.last(F.when(F.col("n").isNotNull(), F.struct("n", "intercept", "beta")), ignorenulls=True).over(w)).where("s is not null").select("decision_session", "alpha", "s.*")
    f = mod.forecasts(z, latest).join(z.select("decision_session", "symbol", F.col("volatility_21").alias("vol")), ["decision_session", "symbol"])
    t = tgt.quantised(tgt.constrained(tgt.desired(f)))
    grid = f.select("alpha", "decision_session", "symbol").join(t, ["alpha", "decision_session", "symbol"], "left")
    nxt = r.select("session").distinct().withColumn("next", F.lead("session").over(Window.orderBy("session"))).where("next is not null")
    weights = grid.join(nxt, F.col("decision_session") == F.col("session")).select(F.concat(F.lit("alpha="), F.col("alpha").cast("string")).alias("strategy"), F.col("next").alias("session"), "symbol", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    out = rep.replay(rep.cost_free(weights, r), spark.createDataFrame([(5.0,)], "cost_bps double"))
    return out.select(F.col("strategy").alias("trial"), "session", F.round("ret", 12).alias("ret"))


@query()
def trial_overfitting(spark, d):
    t = alpha_trials(spark, d).withColumnRenamed("trial", "strategy")
    return an.overfitting_summary(ingest.written(t, "trials"))


@query()
def trials_table(spark, d):
    """The trials written once, in (trial, session) order, with a manifest for each, and scanned back against it."""
    t = ingest.written(alpha_trials(spark, d).sort("trial", "session"), "trials")
    said = digests.manifests(t, "trial", "session", "trials")
    series = t.groupBy("trial").agg(F.count("*").alias("sessions"), F.min("session").alias("start_session"), F.max("session").alias("end_session"))
    return series.join(said, F.lower("trial") == F.col("snapshot_id"), "left").select("trial", "sessions", "start_session", "end_session", (F.col("sessions") == F.col("row_count")).alias("complete"), "content_sha256")


@query(f"{_REPLAY} select distinct strategy, session, 0.0::double as ret, 1000000.0::double as equity from rp")
def cash_baseline(spark, d):
    """What cash makes over the same sessions: nothing."""
    return rep.cash_baseline(_replay(spark, d).select("strategy", "session").distinct(), 1e6)


@query()
def headline(spark, d):
    """The headline of each replay at 5 bps against the equal-weight panel: return, risk, benchmark, final equity and overfitting figures in one row."""
    r = ingest.written(_replay(spark, d).where("cost_bps = 5"), "replay")
    series = r.select("strategy", "session", "ret")
    bench = ingest.written(panel.close_returns(panel.daily_bars(spark, d)).groupBy("session").agg(F.round(F.avg("ret"), 10).alias("ret")), "bench")
    stats = an.performance_summary(series).select("strategy", "sharpe", "annualized_return", "annualized_volatility", "max_drawdown", "sortino", "calmar")
    rel = linear.with_pvalue(an.benchmark_stats(an.aligned(series, bench)), "alpha_tstat", F.col("n_sessions") - 2, "alpha_pvalue").select("strategy", "beta", "alpha_annualized", "alpha_tstat", F.round("alpha_pvalue", 8).alias("alpha_pvalue"), "information_ratio")
    last = r.groupBy("strategy").agg(F.max_by("equity", "session").alias("final"))
    over = an.overfitting_summary(series).select("pbo", F.col("dsr").alias("deflated_sharpe_ratio")) if series.select("strategy").distinct().count() > 1 else None
    out = stats.join(rel, "strategy").join(last, "strategy").select("*", F.round("final", 2).alias("final_equity"), F.round(F.col("final") / 1e6, 4).alias("total_return_multiple")).drop("final")
    return out.join(over, F.lit(True), "left") if over is not None else out
