"""Portfolio targets in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP, MIN_CASH, MAX_VOL = 0.25, 0.05, 0.15
KEYS = ("alpha", "decision_session")


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def qualified(signals: DataFrame) -> DataFrame:
    """Signals (…, symbol, forecast, vol) with finite positive forecast and volatility."""
    return signals.where(finite("forecast") & finite("vol") & (F.col("forecast") > 0) & (F.col("vol") > 0))


def desired(signals: DataFrame, keys: tuple[str, ...] = KEYS, budget: float = 1 - MIN_CASH) -> DataFrame:
    """Conviction (forecast / volatility) shared out to ``budget`` within each decision."""
    c = F.col("forecast") / F.col("vol")
    return qualified(signals).withColumn("desired", budget * c / F.sum(c).over(Window.partitionBy(*keys)))


def constrained(wanted: DataFrame, keys: tuple[str, ...] = KEYS, cap: float = CAP, max_vol: float = MAX_VOL, steps: int = 80) -> DataFrame:
    """Nearest weights to ``desired`` with a cap each and a bound on the sum of squared risks.

    w = min(d / (1 + mu s^2), cap); mu = 0 if the bound holds there, else by bisection, a fold over
    a decision's arrays (one entry a symbol): Sum(d / s)^2 / mu^2 bounds the risk, which gives the upper end.
    """
    item = F.struct("symbol", F.col("desired").alias("d"), F.col("vol").alias("s"))
    x = wanted.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("a"))
    weight = lambda e, mu: F.least(e["d"] / (1 + mu * e["s"] * e["s"]), F.lit(cap))
    risk = lambda mu: F.aggregate("a", F.lit(0.0), lambda acc, e: acc + F.pow(e["s"] * weight(e, mu), 2))
    bound = max_vol * max_vol
    hi = F.sqrt(F.aggregate("a", F.lit(0.0), lambda acc, e: acc + F.pow(e["d"] / e["s"], 2))) / max_vol
    start = F.struct(F.lit(0.0).alias("lo"), hi.alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        over = risk(mid) > bound
        return F.struct(F.when(over, mid).otherwise(acc["lo"]).alias("lo"), F.when(over, acc["hi"]).otherwise(mid).alias("hi"))

    x = x.withColumn("mu", F.when(risk(F.lit(0.0)) <= bound, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["hi"]))
    out = x.select(*keys, "mu", F.explode("a").alias("e"))
    return out.select(*keys, F.col("e.symbol").alias("symbol"), weight(F.col("e"), F.col("mu")).alias("weight"))


def quantised(weights: DataFrame) -> DataFrame:
    """Weights floored to 6 places, zeros dropped."""
    w = F.floor(F.round(F.col("weight") * 1e6, 3)).cast("decimal(12,0)") / F.lit(1000000).cast("decimal(12,0)")
    return weights.withColumn("weight", w.cast("decimal(9,6)")).where("weight > 0")


def cash(weights: DataFrame, all_keys: DataFrame, keys: tuple[str, ...] = KEYS, cap: float = CAP, min_cash: float = MIN_CASH) -> DataFrame:
    """(keys, invested, cash_weight, n, blocked) of every decision; without weights it is all cash. Failed checks block."""
    s = weights.groupBy(*keys).agg(F.sum("weight").alias("invested"), F.max("weight").alias("most"), F.count("*").alias("n"))
    x = all_keys.select(*keys).distinct().join(s, list(keys), "left").fillna(0, ["n"])
    invested = F.coalesce(F.col("invested"), F.lit(0).cast("decimal(9,6)"))
    bad = (F.coalesce("most", F.lit(0)) > cap) | (invested > 1 - min_cash + 1e-9)
    return x.select(*keys, invested.cast("decimal(9,6)").alias("invested"), (1 - invested).cast("decimal(9,6)").alias("cash_weight"), "n", bad.alias("blocked"))


def shares(weights: DataFrame, prices: DataFrame, equity: float) -> DataFrame:
    """Whole shares of each target; missing and non-positive prices and zero results are left out. Joined on (symbol, session)."""
    x = weights.join(prices, ["symbol", "session"]).where("price > 0")
    return x.withColumn("shares", F.floor(equity * F.col("weight").cast("double") / F.col("price")).cast("long")).where("shares > 0")


def composition(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """Weight by asset class (unknown symbols are "Other"), largest first."""
    x = weights.join(classes, "symbol", "left").groupBy("session", F.coalesce("asset_class", F.lit("Other")).alias("asset_class"))
    return x.agg(F.sum("weight").alias("weight")).orderBy("session", F.desc("weight"), "asset_class")
