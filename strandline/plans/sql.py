"""Common table expressions for the oracle SQL (DuckDB)."""

_ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_quantity, l_extendedprice"

TRADES = """px as (
  select r_name as symbol, cast(l_shipdate as date) as session, round(p_retailprice * (1 - l_discount), 4) as price, l_quantity as qty,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_quantity, l_extendedprice
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)"""


def _bars(name: str, session: str) -> str:
    return f"""{name} as (
  select symbol, {session} as session, first(price order by {_ORD}) as open, max(price) as high, min(price) as low, last(price order by {_ORD}) as close,
    sum(qty) as volume, round(sum(price * qty) / sum(qty), 8) as vwap, count(*) as trade_count
  from px group by all)"""


BARS = f"with {TRADES}, {_bars('bars', 'session')}"
WEEKLY = f"with {TRADES}, {_bars('bars', '''cast(date_trunc('week', session) as date)''')}"
RETURNS = f"""{BARS}, returns as (
  select * from (select symbol as strategy, session, round(close / lag(close) over (partition by symbol order by session) - 1, 10) as ret from bars) where ret is not null)"""
FEATURES = f"""{BARS}, f0 as (
  select *, ln(close / lag(close) over w) as lr, row_number() over w as bar_no from bars window w as (partition by symbol order by session)),
f1 as (
  select symbol, session as decision_session,
    close / lag(close, 21) over w - 1 as return_21, close / lag(close, 63) over w - 1 as return_63, close / lag(close, 126) over w - 1 as return_126,
    case when count(lr) over v = 21 then stddev_samp(lr) over v * sqrt(252) end as volatility_21,
    case when count(close) over s = 100 then close / avg(close) over s - 1 end as sma_distance_100,
    case when count(close * volume) over d = 20 then avg(close * volume) over d end as dollar_volume_20,
    lead(close, 21) over w / close - 1 as forward_return_21, lead(session, 21) over w as label_end_session, bar_no
  from f0 window w as (partition by symbol order by session), v as (partition by symbol order by session rows between 20 preceding and current row),
    s as (partition by symbol order by session rows between 99 preceding and current row), d as (partition by symbol order by session rows between 19 preceding and current row)),
features as (
  select symbol, decision_session, {', '.join(f'case when bar_no <= 126 or {c} is null or not isfinite({c}) then 0.0 else round({c}, 8) end as {c}' for c in ('return_21', 'return_63', 'return_126', 'volatility_21', 'sma_distance_100', 'dollar_volume_20'))},
    round(forward_return_21, 8) as forward_return_21, label_end_session, bar_no <= 126 as missing
  from f1)"""
