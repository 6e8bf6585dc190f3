"""Ledgers, and the replay of weights as lags and per-session sums.

With a rebalance to the targets at every open, a session depends on its own row and the one before.
Shares are fractional; the drift's denominator leaves out the previous cost (an error near 5e-6 at 2 bps).
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .analytics import running_product

YEAR = 252


def rebalance_fills(target: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("account", "symbol")) -> DataFrame:
    """Signed quantities from current to target holdings, over the union of keys; none are 0."""
    x = target.withColumnRenamed("qty", "t").join(current.withColumnRenamed("qty", "c"), list(keys), "full")
    return x.select(*keys, (F.coalesce("t", F.lit(0)) - F.coalesce("c", F.lit(0))).alias("qty")).where("qty <> 0")


def fill_ledger(fills: DataFrame, cash: str, bps: str, order: tuple[str, ...]) -> DataFrame:
    """Running position, cash and costs of each account after each fill, in decimals: cost = |q| p bps / 10^4."""
    price = F.col("price").cast("decimal(18,4)")
    notional = (F.col("qty").cast("decimal(12,0)") * price).cast("decimal(28,6)")
    cost = (F.abs(notional) * F.lit(str(Decimal(bps) / 10000)).cast("decimal(12,8)")).cast("decimal(28,8)")
    pos = Window.partitionBy("account", "symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    acc = Window.partitionBy("account").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = fills.withColumn("notional", notional).withColumn("cost", cost)
    return x.withColumns({"position": F.sum("qty").over(pos), "cash": F.lit(cash).cast("decimal(28,8)") - F.sum(F.col("notional") + F.col("cost")).over(acc), "total_costs": F.sum("cost").over(acc)})


def mark_to_market(ledger: DataFrame, closes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(account, cash, value, equity, unpriced) at the end of the ledger; ``closes`` (symbol, close) gives prices, ``unpriced`` counts positions without one."""
    o = F.struct(*order)
    last = ledger.groupBy("account", "symbol").agg(F.max_by("position", o).alias("position")).where("position <> 0")
    cash = ledger.groupBy("account").agg(F.max_by("cash", o).alias("cash"))
    value = last.join(closes, "symbol", "left").groupBy("account").agg(F.sum(F.col("position") * F.col("close")).alias("value"), F.count_if(F.col("close").isNull()).alias("unpriced"))
    x = cash.join(value, "account", "left").fillna(0, ["value", "unpriced"])
    return x.select("account", "cash", "value", (F.col("cash").cast("double") + F.col("value")).alias("equity"), "unpriced")


def price_matrix(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """One column of closes for each named symbol."""
    return bars.groupBy("session").pivot("symbol", symbols).agg(F.first("close"))


def cost_free(weights: DataFrame, bars: DataFrame, key: str = "strategy") -> DataFrame:
    """(key, session, w, den, turn, intraday): what a replay needs of each session before costs. weights: (key, session, symbol, weight); bars must be rectangular."""
    x = weights.join(bars.select("symbol", "session", "open", "close"), ["symbol", "session"])
    w = Window.partitionBy(key, "symbol").orderBy("session")
    x = x.withColumns({"w0": F.lag("weight", 1).over(w), "o0": F.lag("open").over(w)})
    x = x.withColumn("moved", F.coalesce(F.col("w0") * F.col("open") / F.col("o0"), F.lit(0.0))).withColumn("w0", F.coalesce("w0", F.lit(0.0)))
    s = Window.partitionBy(key, "session")
    x = x.withColumn("den", 1 - F.sum("w0").over(s) + F.sum("moved").over(s))
    return x.groupBy(key, "session").agg(F.sum("weight").alias("w"), F.first("den").alias("den"), F.sum(F.abs(F.col("weight") - F.col("moved") / F.col("den"))).alias("turn"), F.sum(F.col("weight") * F.col("close") / F.col("open")).alias("intraday"))


def replay(free: DataFrame, costs: DataFrame, initial: float = 1_000_000.0, key: str = "strategy") -> DataFrame:
    """(key, cost_bps, session, equity, ret, turnover, cost, hit) of each session and cost level."""
    x = free.crossJoin(costs).withColumn("k", F.col("cost_bps") / 1e4 * F.col("turn"))
    x = x.withColumn("cl", 1 - F.col("w") - F.col("k") + F.col("intraday"))
    w = Window.partitionBy(key, "cost_bps").orderBy("session")
    x = x.withColumns({"k0": F.lag("k").over(w), "cl0": F.lag("cl").over(w)})
    open_ = F.coalesce((F.col("den") - F.col("k0")) / F.col("cl0"), F.lit(1.0))
    x = x.withColumn("gap", open_).withColumn("f", F.col("gap") * F.col("cl"))
    x = running_product(x, [key, "cost_bps"], "session", F.col("f"), "growth")
    before = F.col("growth") / F.col("f")
    return x.select(key, "cost_bps", "session", (initial * F.col("growth")).alias("equity"), (F.col("f") - 1).alias("ret"), (F.col("turn") * F.col("gap")).alias("turnover"), (F.col("k") * F.col("gap") * before * initial).alias("cost"), (F.col("f") > 1).alias("hit"))


def contribution(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Buy-and-hold return of each symbol inside a range."""
    x = bars.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return x.groupBy("symbol").agg((F.max_by("close", "session") / F.min_by("close", "session") - 1).alias("contribution"))


def cash_baseline(sessions: DataFrame, initial: float) -> DataFrame:
    """(strategy, session, ret, equity) of holding cash over the sessions."""
    return sessions.select("strategy", "session", F.lit(0.0).alias("ret"), F.lit(float(initial)).alias("equity"))


def metrics(curve: DataFrame, keys: tuple[str, ...], initial: float = 1_000_000.0) -> DataFrame:
    """Report metrics of each (key, cost) or window: geometric return over volatility as Sharpe; the drawdown's peak starts at the opening equity.

    curve: replay rows; a group's opening equity is that before its first session.
    """
    w = Window.partitionBy(*keys).orderBy("session")
    x = curve.withColumn("open_equity", F.col("equity") / (1 + F.col("ret")))
    x = x.withColumn("start", F.first("open_equity").over(w)).withColumn("peak", F.greatest("start", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    g = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("start").alias("start"), F.max_by("equity", "session").alias("final"), F.stddev_samp("ret").alias("sd"), F.least(F.lit(0.0), F.min(F.col("equity") / F.col("peak") - 1)).alias("mdd"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("turnover").alias("turnover"), F.sum("cost").alias("total_costs"), F.min("session").alias("start_session"), F.max("session").alias("end_session"),
    )
    ann = F.when((F.col("start") <= 0) | (F.col("final") <= 0), 0.0).otherwise(F.pow(F.col("final") / F.col("start"), YEAR / F.col("n")) - 1)
    vol = F.coalesce(F.col("sd"), F.lit(0.0)) * math.sqrt(YEAR)
    r = lambda c: F.round(c, 8)
    return g.select(*keys, "n", "start_session", "end_session", r(ann).alias("annualized_return"), r(vol).alias("annualized_volatility"), r(F.when(vol > 0, ann / vol).otherwise(0.0)).alias("sharpe"), r("mdd").alias("max_drawdown"), F.round("total_costs", 4).alias("total_costs"), r("turnover").alias("turnover"), r("hit_rate").alias("hit_rate"))


def windows(curve: DataFrame, keys: tuple[str, ...], size: int = 63) -> DataFrame:
    """Metrics of consecutive blocks of ``size`` sessions; shorter ones than 63 are left out."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("session")) - 1
    return metrics(curve.withColumn("block", F.floor(i / size).cast("int")), (*keys, "block")).where("n >= 63")
