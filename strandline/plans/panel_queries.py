"""Queries of sources, quality rules, calendars and features, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars as cal
from ..operators import features as feat
from ..operators import validation as val
from ..sources import digests, ingest, panel
from . import sql as S

Q, SQL = {}, {}
START, END, LATEST = "1996-01-01", "1998-12-31", "2001-11-04"


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


@query(f"{S.BARS} select symbol, session, open, close, volume from bars where session between date '{START}' and date '{END}' and symbol <> 'ASIA'")
def panel_scan(spark, d):
    u = panel.universe(spark, d).where("symbol <> 'ASIA'")
    return panel.scan(panel.daily_bars(spark, d), u, START, END).select("symbol", "session", "open", "close", "volume")


@query(f"{S.BARS} select * from bars")
def daily_bars(spark, d):
    return panel.daily_bars(spark, d)


@query(f"{S.WEEKLY} select * from bars")
def weekly_bars(spark, d):
    return panel.weekly_bars(spark, d)


@query(f"""{S.BARS}, ok as (select * from bars where open > 0 and high > 0 and low > 0 and close > 0 and volume > 0),
full_ as (select session from ok group by session having count(distinct symbol) = (select count(distinct symbol) from ok)),
h as (select symbol, session, open, greatest(open, high, low, close) as high, least(open, high, low, close) as low, close, volume, trade_count from ok where session in (select session from full_))
select symbol, session, open, high, low, close, volume, round((high + low + close) / 3, 4) as vwap, trade_count from h""")
def rectangular_panel(spark, d):
    return panel.rectangular(panel.daily_bars(spark, d))


_CONTRACT = {"symbol": "string", "session": "date", **dict.fromkeys(("open", "high", "low", "close", "volume", "vwap"), "double"), "trade_count": "bigint"}


@query(f"{S.BARS} " + " union all ".join(f"select '{c}' as column, '{t}' as wanted, '{t}' as found, true as ok, count(*) filter ({c} is null) as nulls from bars" for c, t in _CONTRACT.items()) + " union all select 'source', 'string', null, false, null")
def schema_contract(spark, d):
    return ingest.contract(panel.daily_bars(spark, d), ", ".join(f"{c} {t}" for c, t in _CONTRACT.items()) + ", source string")


_D4S = ("open", "high", "low", "close", "volume", "vwap")
_DEPTH = 2


def _stored(bars):
    """Bars as a snapshot holds them: decimals of four places, whose text is the same everywhere."""
    return bars.withColumns({c: F.col(c).cast("decimal(20,4)") for c in _D4S})


def _tree_sql(name: str, rows: str) -> str:
    """CTEs of the digest tree of ``rows``: name_0 (the root) to name_2 (the leaves)."""
    text = " || '|' || ".join(f"strlen({v}) || ':' || {v}" for c in sorted((*_D4S, "session", "symbol", "trade_count")) for v in [f"{c}::decimal(20,4)::varchar" if c in _D4S else f"{c}::varchar"])
    return f"""{name}_h as (select sha256({text}) as h, count(*) as n from {rows} group by 1),
{name}_2 as (select 2 as level, h[1:2] as node, sum(n)::bigint as rows, sha256(string_agg(h || '*' || n, ',' order by h || '*' || n)) as sha256 from {name}_h group by 2),
{name}_1 as (select 1 as level, node[1:1] as node, sum(rows)::bigint as rows, sha256(string_agg(node[2:2] || '=' || sha256, ',' order by node)) as sha256 from {name}_2 group by 2),
{name}_0 as (select 0 as level, '' as node, sum(rows)::bigint as rows, sha256(string_agg(node || '=' || sha256, ',' order by node)) as sha256 from {name}_1)"""


_NODES = "select * from t_0 union all select * from t_1 union all select * from t_2"


@query(f"{S.BARS}, {_tree_sql('t', 'bars')} select rows, {_DEPTH} as depth, sha256 from t_0")
def snapshot_digest(spark, d):
    return digests.digest(_stored(panel.daily_bars(spark, d)), _DEPTH)


@query(f"{S.BARS}, {_tree_sql('t', 'bars')} {_NODES}")
def snapshot_tree(spark, d):
    """Every node of the digest tree of the daily bars."""
    return digests.tree(_stored(panel.daily_bars(spark, d)), _DEPTH)


_CHANGED = "symbol = 'ASIA' and session = date '1996-05-06'"


@query(f"""{S.BARS}, other as (select * replace (case when {_CHANGED} then close + 1 else close end as close) from bars), {_tree_sql('t', 'bars')}, {_tree_sql('u', 'other')},
a as ({_NODES}), b as ({_NODES.replace('t_', 'u_')})
select coalesce(a.level, b.level) as level, coalesce(a.node, b.node) as node, coalesce(a.rows, 0) as rows, coalesce(b.rows, 0) as other_rows from a full join b on a.level = b.level and a.node = b.node where a.sha256 is distinct from b.sha256""")
def snapshot_differences(spark, d):
    """Where the trees of the bars and of the bars with one changed price differ: the leaves of the old and the new row, and the way up."""
    bars = _stored(panel.daily_bars(spark, d))
    other = bars.withColumn("close", F.when(F.expr(_CHANGED), F.col("close") + 1).otherwise(F.col("close")).cast("decimal(20,4)"))
    return digests.differences(digests.tree(bars, _DEPTH), digests.tree(other, _DEPTH))


_FULL_SQL = """ok as (select * from bars where open > 0 and high > 0 and low > 0 and close > 0 and volume > 0),
full_ as (select session from ok group by session having count(distinct symbol) = (select count(distinct symbol) from ok)),
fb as (select symbol, session, round(open, 4) as open, greatest(round(open, 4), round(high, 4), round(low, 4), round(close, 4)) as high, least(round(open, 4), round(high, 4), round(low, 4), round(close, 4)) as low, round(close, 4) as close, volume, trade_count from ok where session in (select session from full_)),
rect as (select *, round((high + low + close) / 3, 4) as vwap from fb)"""


@query(f"{S.BARS}, {_FULL_SQL}, {_tree_sql('t', 'rect')} select 'bars' as dataset, rows, {_DEPTH} as depth, sha256, true as verified, 0::bigint as bad_leaves from t_0")
def snapshot_verify(spark, d):
    """The sessions that every symbol has, through the whole quality gate, published, read back and held against their tree."""
    bars = ingest.written(panel.rectangular(panel.daily_bars(spark, d)), "bars")
    u = bars.select("symbol").distinct()
    latest = str(bars.agg(F.max("session")).first()[0])
    return digests.publish_and_verify(_stored(bars), "bars", val.quality_report(bars, u, cal.observed(bars), latest), _DEPTH)


@query()
def manifest_lookup(spark, d):
    """Manifests of two datasets, daily and weekly bars, and those of one of them."""
    both = digests.manifests(panel.daily_bars(spark, d), "symbol", "session").unionByName(digests.manifests(panel.weekly_bars(spark, d), "symbol", "session", "weekly"))
    return ingest.lookup(both, "bars")


_D4 = lambda c: f"cast({c}::varchar as decimal(18,4)) as {c}"


@query(f"{S.BARS} select symbol, session, {_D4('open')}, {_D4('high')}, {_D4('low')}, {_D4('close')}, volume::bigint as volume, {_D4('vwap')}, trade_count, '' as reason from bars")
def ingest_bars_json(spark, d):
    """Bars as response payloads, one for each session, parsed back."""
    return ingest.bars_from_json(ingest.bars_to_json(panel.daily_bars(spark, d)), "payload")


_RAW = (*ingest.STATES, "unheard_of")


@query(f"""with r as (select *, list_extract([{', '.join(f"'{s}'" for s in _RAW)}], (o_orderkey % {len(_RAW)} + 1)::int) as s from orders)
select o_orderkey as order_id, case when s in ('filled', 'calculated') then 'filled' when s = 'partially_filled' then 'partially_filled'
  when s in ('canceled', 'expired', 'rejected', 'replaced', 'done_for_day', 'suspended') then 'rejected' else 'new' end as state,
  cast(floor(o_totalprice / 1000) as bigint) as qty, 0::bigint as filled_qty from r""")
def normalize_orders(spark, d):
    """Raw records with every broker state and one that is unknown, in either case."""
    state = F.element_at(F.lit(list(_RAW)), (F.col("o_orderkey") % len(_RAW) + 1).cast("int"))
    raw = panel.table(spark, d, "orders").select(
        F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_custkey") % 2 == 0, F.upper(state)).otherwise(state).alias("status"), F.floor(F.col("o_totalprice") / 1000).cast("string").alias("qty"))).alias("payload")
    )
    return ingest.orders_from_json(raw, "payload").select(F.col("order_id").cast("bigint").alias("order_id"), "state", "qty", "filled_qty")


@query()
def evidence_rows(spark, d):
    return ingest.evidence(panel.daily_bars(spark, d), "bar", "1998-01-01 00:00:00", "session")


@query(f"{S.BARS} select * from bars")
def evidence_roundtrip(spark, d):
    bars = panel.daily_bars(spark, d)
    return ingest.reload(ingest.evidence(bars, "bar", "1998-01-01 00:00:00", "session"), bars.schema)


@query(f"{S.BARS} select 'bar' as kind, session as decision_session, symbol, close, trade_count, null::double as absent from bars")
def evidence_fields(spark, d):
    """Evidence payloads read by path, without a schema."""
    rows = ingest.evidence(panel.daily_bars(spark, d), "bar", "1998-01-01 00:00:00", "session")
    wanted = {"symbol": ("$.symbol", "string"), "close": ("$.close", "double"), "trade_count": ("$.trade_count", "bigint"), "absent": ("$.nothing.here", "double")}
    return ingest.fields(rows, "payload", wanted, "kind", "decision_session")


@query(f"{S.BARS}, k as (select unnest(['symbol', 'session', 'open', 'high', 'low', 'close', 'volume', 'vwap', 'trade_count']) as key) select key, case key when 'symbol' then 'string' when 'session' then 'string' when 'trade_count' then 'bigint' else 'number' end as kind, count(*) as n from bars, k group by all")
def evidence_keys(spark, d):
    """What the payloads of the evidence hold: keys and kinds."""
    rows = ingest.evidence(panel.daily_bars(spark, d), "bar", "1998-01-01 00:00:00", "session")
    found = ingest.keys_of(rows, "payload")
    return found.groupBy("key", F.when(F.col("kind").isin("double", "decimal"), "number").otherwise(F.col("kind")).alias("kind")).agg(F.sum("n").alias("n"))


@query("""with n as (select distinct 'c-' || o_custkey::varchar || '-' || cast(o_orderdate as date)::varchar as client_order_id from orders where o_orderstatus <> 'F'),
s as (select distinct 'c-' || o_custkey::varchar || '-' || cast(o_orderdate as date)::varchar as client_order_id from orders where o_orderstatus = 'F')
select client_order_id from n where client_order_id not in (select client_order_id from s)""")
def intents_to_insert(spark, d):
    o = panel.table(spark, d, "orders").withColumn("client_order_id", F.concat_ws("-", F.lit("c"), F.col("o_custkey").cast("string"), F.to_date("o_orderdate").cast("string")))
    return ingest.to_insert(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), "client_order_id").select("client_order_id")


@query("select 'c-' || o_custkey::varchar || '-' || cast(o_orderdate as date)::varchar as client_order_id, count(*) as n from orders group by all")
def intent_counts(spark, d):
    o = panel.table(spark, d, "orders").withColumn("client_order_id", F.concat_ws("-", F.lit("c"), F.col("o_custkey").cast("string"), F.to_date("o_orderdate").cast("string")))
    return ingest.stored_counts(o, "client_order_id")


@query()
def run_list(spark, d):
    """Run records written as JSON lines with some unreadable ones between them; the readable ones, newest first."""
    return ingest.runs_from_text(ingest.run_lines(panel.table(spark, d, "orders")))


# --- quality rules


def _dirty(spark, d):
    """Daily bars with faults that follow from their values, so that every rule finds some."""
    b = panel.daily_bars(spark, d)
    k = F.dayofmonth("session")
    return b.withColumns({
        "high": F.when(k == 3, F.col("low") - 1).otherwise(F.col("high")),
        "vwap": F.when(k == 5, F.lit(float("nan"))).when(k == 7, F.lit(None).cast("double")).otherwise(F.col("vwap")),
        "open": F.when(k == 9, -F.col("open")).otherwise(F.col("open")),
        "symbol": F.when((F.col("symbol") == "ASIA") & (k == 11), F.lit("MARS")).otherwise(F.col("symbol")),
    }).where("not (symbol = 'EUROPE' and dayofmonth(session) = 13)")


_DIRTY = f"""{S.BARS}, dirty as (
  select case when symbol = 'ASIA' and day(session) = 11 then 'MARS' else symbol end as symbol, session,
    case when day(session) = 9 then -open else open end as open, case when day(session) = 3 then low - 1 else high end as high, low, close, volume,
    case when day(session) = 5 then 'nan'::double when day(session) = 7 then null else vwap end as vwap, trade_count
  from bars where not (symbol = 'EUROPE' and day(session) = 13))"""


@query(f"""{_DIRTY} select symbol, session, reasons from (
  select symbol, session, array_to_string(list_sort(list_filter([
    case when not coalesce(open > 0, false) then 'open_not_positive' end, case when not coalesce(high > 0, false) then 'high_not_positive' end,
    case when not coalesce(vwap > 0, false) then 'vwap_not_positive' end,
    case when not (high >= greatest(open, low, close)) then 'high_below_others' end, case when not (low <= least(open, high, close)) then 'low_above_others' end], lambda x: x is not null)), ',') as reasons from dirty)
  where reasons <> ''""")
def ohlc_violations(spark, d):
    return val.ohlc_violations(_dirty(spark, d)).select("symbol", "session", "reasons")


@query("""select p_partkey, upper(trim(symbol)) as symbol, regexp_full_match(upper(trim(symbol)), '[A-Z][A-Z0-9.-]{0,14}') and country = 'US' as valid
from (select p_partkey, ' ' || replace(lower(p_brand), '#', case when p_size % 3 = 0 then '#' else '.' end) || '  ' as symbol, case when p_size % 5 = 0 then 'CA' else 'US' end as country from part)""")
def normalize_symbols(spark, d):
    p = panel.table(spark, d, "part").selectExpr("p_partkey", "concat(' ', replace(lower(p_brand), '#', case when p_size % 3 = 0 then '#' else '.' end), '  ') as symbol", "case when p_size % 5 = 0 then 'CA' else 'US' end as country")
    return val.normalize_symbols(p, "symbol", "country").select("p_partkey", "symbol", "valid")


@query("select p_brand as universe_version, p_type as symbol, count(*) as n from part group by all having count(*) > 1")
def universe_duplicates(spark, d):
    return val.universe_duplicates(panel.table(spark, d, "part").select(F.col("p_brand").alias("universe_version"), F.col("p_type").alias("symbol")))


@query(f"{S.BARS} select 1 as seq, 'empty_input' as code, 'block' as severity, 'no bars' as message from (select count(*) as n from bars where session < date '1900-01-01') where n = 0")
def q_empty(spark, d):
    return val.empty_input(panel.daily_bars(spark, d).where("session < date '1900-01-01'"))


@query(f"{_DIRTY} select distinct 2 as seq, 'symbol_outside_universe' as code, 'block' as severity, symbol as message from dirty where symbol not in (select r_name from region)")
def q_outside(spark, d):
    return val.symbol_outside_universe(_dirty(spark, d), panel.universe(spark, d))


@query(f"{_DIRTY} select 3 as seq, 'missing_universe_symbol' as code, 'block' as severity, r_name as message from region where r_name not in (select symbol from dirty where symbol <> 'AFRICA')")
def q_missing_symbol(spark, d):
    return val.missing_universe_symbol(_dirty(spark, d).where("symbol <> 'AFRICA'"), panel.universe(spark, d))


@query(f"with {S.TRADES} select symbol, session, count(*) as n from px group by all having count(*) > 1 order by symbol, session limit 5")
def q_duplicates(spark, d):
    return val.duplicate_bars(panel.trades(spark, d))


@query("""select user_id, event_id from (select *, lag(row(ts, event_type)) over (partition by user_id order by event_id) as before from events) where before > row(ts, event_type)""")
def q_unsorted(spark, d):
    e = panel.table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("session"), F.col("event_type").alias("symbol"))
    return val.unsorted_bars(e, "event_id", ("user_id",)).select("user_id", "event_id")


@query(f"{_DIRTY} select 'vwap' as field, count(*) as n from dirty where vwap is null or not isfinite(vwap) having count(*) > 0")
def q_nonfinite(spark, d):
    return val.non_finite_values(_dirty(spark, d))


@query(f"{S.BARS} select 7 as seq, 'latest_session_mismatch' as code, 'block' as severity, max(session)::varchar as message from bars having max(session) is distinct from date '2002-01-01'")
def q_latest(spark, d):
    return val.latest_session_mismatch(panel.daily_bars(spark, d), "2002-01-01")


@query(f"{S.BARS} select 8 as seq, 'incomplete_latest_session' as code, 'block' as severity, r_name as message from region where r_name not in (select symbol from bars where session = date '{LATEST}')")
def q_incomplete_latest(spark, d):
    return val.incomplete_latest_session(panel.daily_bars(spark, d), panel.universe(spark, d), LATEST)


@query(f"""{_DIRTY}, cal as (select distinct session from bars), sp as (select symbol, min(session) lo, max(session) hi from dirty group by symbol),
due as (select symbol, session from sp join cal on session between lo and hi)
select symbol, count(*) as missing, min(session) as first_gap from due where (symbol, session) not in (select (symbol, session) from dirty) group by symbol""")
def q_missing_session(spark, d):
    return val.missing_sessions(_dirty(spark, d), cal.observed(panel.daily_bars(spark, d)))


_SYMBOLS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MARS", "MIDDLE EAST")


@query(f"""{_DIRTY}, cal as (select distinct session from bars), sp as (select symbol, min(session) lo, max(session) hi from dirty group by symbol),
due as (select symbol, session from sp join cal on session between lo and hi), gaps as (select symbol, count(*) n, min(session) f from due where (symbol, session) not in (select (symbol, session) from dirty) group by symbol),
o as (select session, symbol, (session - date '1995-01-01') * 10 + (case when day(session) = 17 then 10 - p else p end) as row_no from (select *, list_position([{', '.join(f"'{s}'" for s in _SYMBOLS)}], symbol) as p from dirty)),
i as (
  select 2 as seq, 'symbol_outside_universe' as code, symbol as message from (select distinct symbol from dirty) where symbol not in (select r_name from region)
  union all select 3, 'missing_universe_symbol', r_name from region where r_name not in (select symbol from dirty)
  union all select 4, 'duplicate_bar', symbol || ' ' || session from dirty group by symbol, session having count(*) > 1
  union all select 5, 'unsorted_bars', 'bars are not sorted by (session, symbol)' where exists (select 1 from (select row(session, symbol) as k, lag(row(session, symbol)) over (order by row_no) as b from o) where b > k)
  union all select 6, 'non_finite_value', 'vwap' where exists (select 1 from dirty where vwap is null or not isfinite(vwap))
  union all select 7, 'latest_session_mismatch', max(session)::varchar from dirty having max(session) is distinct from date '{LATEST}'
  union all select 8, 'incomplete_latest_session', r_name from region where r_name not in (select symbol from dirty where session = date '{LATEST}') and (select max(session) from dirty) = date '{LATEST}'
  union all select 9, 'missing_session', symbol || ' ' || n || ' ' || f from gaps)
select seq, code, 'block' as severity, message, true as blocked from i""")
def quality_report(spark, d):
    """All rules over bars with faults; on the 17th of a month the rows stand in reverse order."""
    bars = panel.daily_bars(spark, d)
    p = F.array_position(F.lit(list(_SYMBOLS)), F.col("symbol"))
    no = F.datediff("session", F.lit("1995-01-01")) * 10 + F.when(F.dayofmonth("session") == 17, 10 - p).otherwise(p)
    dirty = ingest.written(_dirty(spark, d).withColumn("row_no", no), "dirty")
    return val.quality_report(dirty, panel.universe(spark, d), cal.observed(bars), LATEST, "row_no")


# --- calendars

_CAL = """cal as (select session, row_number() over (order by session) as session_idx, session::timestamp + interval 21 hour as close_ts from (
  select cast(unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day)) as date) as session)
  where dayofweek(session) between 1 and 5 and session not in (select cast(o_orderdate as date) from orders where day(o_orderdate) = 4 and month(o_orderdate) = 7))"""


def _calendar(spark, d):
    holidays = panel.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session")).where("day(session) = 4 and month(session) = 7").distinct()
    return cal.build(spark, "1995-01-01", "2001-12-31", holidays)


@query(f"with {_CAL} select session, session_idx::int as session_idx, close_ts::varchar as close_ts from cal")
def calendar_dim(spark, d):
    return _calendar(spark, d).withColumn("close_ts", F.col("close_ts").cast("string"))


@query(f"with {_CAL} select session, session_idx::int as session_idx from cal where session between date '{START}' and date '{END}'")
def sessions_in_range(spark, d):
    return cal.between(_calendar(spark, d), START, END).select("session", "session_idx")


@query(f"""with {_CAL}, t as (select distinct date_trunc('hour', ts) as ts from events union select distinct cast(l_shipdate as timestamp) + interval 21 hour from lineitem)
select ts::varchar as ts, (select max(session) from cal where close_ts <= t.ts) as last_session from t""")
def last_completed_session(spark, d):
    t = panel.table(spark, d, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).union(panel.table(spark, d, "lineitem").select(F.to_date("l_shipdate").cast("timestamp") + F.expr("interval 21 hours"))).distinct()
    return cal.last_completed(t, _calendar(spark, d), "ts").withColumn("ts", F.col("ts").cast("string"))


@query(f"with {_CAL} select a.session, b.session as embargo_start from cal a left join cal b on b.session_idx = a.session_idx - 20")
def embargo_start(spark, d):
    return cal.embargo_start(_calendar(spark, d), 21)


@query(f"""{S.BARS}, cal as (select distinct session from bars), sp as (select symbol, min(session) lo, max(session) hi, count(distinct session) present from bars group by symbol)
select symbol, any_value(present) as present, count(*) as expected, round(any_value(present) / count(*), 10) as completeness, greatest(count(*) - any_value(present), 0) as excluded from sp join cal on session between lo and hi group by symbol""")
def panel_completeness(spark, d):
    b = panel.daily_bars(spark, d)
    return cal.completeness(b, cal.observed(b))


# --- features


def _some(columns: str):
    cols = [c.strip() for c in columns.split(",")]
    Qf = ", ".join(f"round({c}, 8) as {c}" if not c.endswith("session") else c for c in cols)
    return f"{S.FEATURES} select symbol, decision_session, {Qf} from f1", cols


def _raw(spark, d, cols):
    x = feat.raw_features(ingest.written(panel.daily_bars(spark, d), "bars")).withColumnRenamed("session", "decision_session")
    return x.select("symbol", "decision_session", *[F.round(c, 8).alias(c) if not c.endswith("session") else F.col(c) for c in cols])


for _name, _cols in {"feat_returns": "return_21, return_63, return_126", "feat_volatility": "volatility_21", "feat_sma_distance": "sma_distance_100", "feat_dollar_volume": "dollar_volume_20", "feat_labels": "forward_return_21, label_end_session"}.items():
    SQL[_name], _list = _some(_cols)
    Q[_name] = lambda spark, d, cols=tuple(_list): _raw(spark, d, cols)


def features(spark, d):
    return feat.feature_rows(ingest.written(panel.daily_bars(spark, d), "bars"), "daily")


@query(f"{S.FEATURES} select *, 'daily' as snapshot_id from features")
def feature_rows(spark, d):
    return features(spark, d)


@query(f"{S.FEATURES} select symbol, decision_session, 0.0 as z from features where false")
def leakage_audit(spark, d):
    return feat.leakage(ingest.written(panel.daily_bars(spark, d), "bars"), "1998-06-30").select("symbol", "decision_session", F.lit(0.0).alias("z"))


@query(f"""{S.FEATURES} select symbol, decision_session, {', '.join(f'case when stddev_samp({c}) over w > 1e-12 then round(({c} - avg({c}) over w) / stddev_samp({c}) over w, 6) else 0.0 end as z_{c}' for c in feat.FEATURES)}
from features where not missing window w as (partition by decision_session)""")
def xs_zscore(spark, d):
    z = feat.xs_zscore(features(spark, d).where("not missing"))
    return z.select("symbol", "decision_session", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in feat.FEATURES])
