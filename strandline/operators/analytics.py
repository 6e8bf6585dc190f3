"""Return-series analytics, keyed by ``strategy``: one job serves any number of series.

Input: returns (strategy, session, ret). Running and trailing figures are taken in ranges and blocks of a
series (``functions.blocks``) and quantiles by distributed selection, so one long series is many tasks' work.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, normal, quantiles
from ..sources.tables import written

YEAR = 252
PLACES = 10


def r10(c: Column) -> Column:
    return F.round(c, PLACES)


SERIES = ["strategy"]


def _parts(factor: Column) -> dict[str, Column]:
    """What the product of factors of any sign is summed up from: zeros, minus signs, logs of sizes."""
    return {"zeros": (factor == 0).cast("long"), "minus": (factor < 0).cast("long"), "logs": F.when(factor != 0, F.log(F.abs(factor))).otherwise(0.0)}


def _product(zeros: Column, minus: Column, logs: Column) -> Column:
    return F.when(zeros > 0, 0.0).when(minus % 2 == 1, -F.exp(logs)).otherwise(F.exp(logs))


def product(factor: Column) -> Column:
    """Product of factors of any sign, as an aggregate."""
    return _product(*[F.sum(c) for c in _parts(factor).values()])


def equity_returns(equity: DataFrame, initial: float) -> DataFrame:
    x, before = blocks.previous(equity, SERIES, "session", "equity", "__last", F.lit(float(initial))), F.col("__last")
    return x.select("strategy", "session", r10(F.when(before <= 0, 0.0).otherwise(F.col("equity") / before - 1)).alias("ret"))


def running_product(df: DataFrame, by: list[str], order: str, factor: Column, name: str) -> DataFrame:
    """``df`` with the product of ``factor`` over all rows of the series up to each."""
    sums = {f"__{n}": (c, "sum") for n, c in _parts(factor).items()}
    return blocks.running(df, by, order, sums).withColumn(name, _product(*map(F.col, sums))).drop(*sums)


def growth_curve(returns: DataFrame, initial: float = 1.0) -> DataFrame:
    return running_product(returns, SERIES, "session", 1 + F.col("ret"), "equity").withColumn("equity", initial * F.col("equity"))


def annualized_return(growth: Column, n: Column) -> Column:
    return F.when(growth <= 0, -1.0).otherwise(F.pow(growth, YEAR / n) - 1)


def ratio(mean: Column, sd: Column) -> Column:
    return F.coalesce(F.when(sd > 0, mean / sd), F.lit(0.0))


def period_sharpe(returns: DataFrame) -> DataFrame:
    return returns.groupBy("strategy").agg(ratio(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.count("*").alias("n"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(strategy, session, r, b): inner join of many series with one benchmark on the session."""
    return a.select("strategy", "session", F.col("ret").alias("r")).join(b.select("session", F.col("ret").alias("b")), "session").select("strategy", "session", "r", "b")


def drawdowns(returns: DataFrame) -> DataFrame:
    """(strategy, session, idx, ret, equity, peak, dd); the peak begins at the first 1 + r."""
    x = growth_curve(returns)
    x = blocks.running(x, SERIES, "session", {"peak": (F.col("equity"), "max"), "idx": (F.lit(1), "sum")})
    return x.withColumn("dd", F.col("equity") / F.col("peak") - 1)


EPS = 1e-12


def drawdown_duration(dd: DataFrame) -> DataFrame:
    """Longest run under water: gaps and islands."""
    under = F.col("dd") < -EPS
    runs = blocks.running(dd, SERIES, "session", {"island": ((~under).cast("int"), "sum")}).where(under).groupBy("strategy", "island").count()
    return dd.select("strategy").distinct().join(runs.groupBy("strategy").agg(F.max("count").alias("m")), "strategy", "left").select("strategy", F.coalesce("m", F.lit(0)).alias("max_drawdown_duration"))


def time_to_recovery(dd: DataFrame) -> DataFrame:
    """Sessions from the first deepest trough to the first equity at its peak; null if there is none."""
    deep = dd.groupBy("strategy").agg(F.min_by(F.struct("idx", "peak"), F.struct(F.round("dd", 12), "idx")).alias("t"))
    later = dd.join(deep, "strategy").where((F.col("idx") > F.col("t.idx")) & (F.col("equity") >= F.col("t.peak") * (1 - EPS)))
    found = later.groupBy("strategy").agg((F.min("idx") - F.min("t.idx")).alias("time_to_recovery"))
    return deep.select("strategy").join(found, "strategy", "left")


def tail_quantiles(returns: DataFrame, **levels: float) -> DataFrame:
    """(strategy, names...): the exact quantile below each level."""
    return quantiles.quantiles(returns, "strategy", "ret", {n: round(1 - x, 10) for n, x in levels.items()})


def var_cvar(returns: DataFrame, level: float) -> DataFrame:
    q = tail_quantiles(returns, q=level)
    tail = returns.join(q, "strategy").groupBy("strategy").agg(F.first("q").alias("q"), F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret"))).alias("t"))
    return tail.select("strategy", r10(F.greatest(F.lit(0.0), -F.col("q"))).alias("var"), r10(F.greatest(F.lit(0.0), -F.coalesce("t", "q"))).alias("cvar"))


def moments(returns: DataFrame) -> DataFrame:
    """(strategy, n, mean, sd, skew, kurt): bias-corrected skewness and excess kurtosis, 0 for too few rows."""
    m = returns.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"))
    return m.select("strategy", "n", "mean", "sd", *corrected())


def corrected() -> tuple[Column, Column]:
    """Bias-corrected skew and kurt from n and the population figures g1 and g2."""
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).otherwise(0.0)
    return F.coalesce(skew, F.lit(0.0)).alias("skew"), F.coalesce(kurt, F.lit(0.0)).alias("kurt")


def cornish_fisher_value(level: float, n: Column, mean: Column, sd: Column, skew: Column, kurt: Column, quantile_: Column) -> Column:
    """The modified value at risk; the historical one for fewer than four rows, 0 without dispersion."""
    z = NormalDist().inv_cdf(1 - level)
    zc = z + (z**2 - 1) * skew / 6 + (z**3 - 3 * z) * kurt / 24 - (2 * z**3 - 5 * z) * skew * skew / 36
    value = F.when(n < 4, -quantile_).when(sd == 0, 0.0).otherwise(-(mean + zc * sd))
    return r10(F.greatest(F.lit(0.0), value))


def cornish_fisher(returns: DataFrame, level: float = 0.95) -> DataFrame:
    m = moments(returns).join(tail_quantiles(returns, q=level), "strategy")
    return m.select("strategy", cornish_fisher_value(level, *(F.col(c) for c in ("n", "mean", "sd", "skew", "kurt", "q"))).alias("cornish_fisher_var"))


def rolling_sharpe(returns: DataFrame, window: int = 126) -> DataFrame:
    """Trailing Sharpe ratio, not rounded; null until the window is filled."""
    def columns(w):
        own = w(window - 1)
        value = ratio(F.avg("ret").over(own), F.stddev_samp("ret").over(own)) * math.sqrt(YEAR)
        return [{"rolling_sharpe": F.when(F.count("ret").over(own) == window, value)}]

    return blocks.windowed(returns, SERIES, "session", columns, window, place="__place").drop("__place")


def histogram(returns: DataFrame, bins: int = 41) -> DataFrame:
    """(strategy, bin, centre, n): equal widths, the last bin closed; a constant series is widened by half on either side; empty bins are kept."""
    span = returns.groupBy("strategy").agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select("strategy", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    placed = returns.join(span, "strategy").withColumn("bin", F.least(F.floor((F.col("ret") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int"))
    n = placed.groupBy("strategy", "bin").agg(F.count("*").alias("n"))
    dense = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return dense.join(n, ["strategy", "bin"], "left").select("strategy", "bin", F.round(F.col("lo") + (F.col("bin") + 0.5) * F.col("width"), 8).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def logit_histogram(logits: DataFrame, bins: int = 21) -> DataFrame:
    """(bin, centre, n) of the logits of a cross-validation; none without logits."""
    x = histogram(logits.select(F.lit("logit").alias("strategy"), F.col("logit").alias("ret")), bins)
    return x.select("bin", F.round("centre", 4).alias("centre"), "n")


def compounded(returns: DataFrame, *parts: str) -> DataFrame:
    """Compound returns of calendar parts: ``year`` or ``year``, ``month``."""
    keys = [getattr(F, p)("session").alias(p) for p in parts]
    return returns.groupBy("strategy", *keys).agg(r10(product(1 + F.col("ret")) - 1).alias("ret"))


def performance_summary(returns: DataFrame) -> DataFrame:
    """Nineteen statistics of each series: one wide aggregate over its drawdowns, joined with the few that need its results.

    The drawdowns of all series are written once, as the aggregate, the runs, the recovery and the tails read them.
    """
    dd = written(drawdowns(returns), "drawdowns")
    q = written(tail_quantiles(dd, q95=0.95, q99=0.99), "quantiles")
    wide = dd.groupBy("strategy").agg(
        F.count("*").alias("n"), product(1 + F.col("ret")).alias("growth"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2))).alias("down"),
        F.min("dd").alias("mdd"), F.max("ret").alias("best_day"), F.min("ret").alias("worst_day"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_fraction"),
        F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"),
    ).join(q, "strategy")
    tail = lambda q: F.avg(F.when(F.col("ret") <= F.col(q), F.col("ret")))
    tails = dd.join(q, "strategy").groupBy("strategy").agg(tail("q95").alias("t95"), tail("q99").alias("t99"))
    x = wide.select("*", *corrected()).join(tails, "strategy").join(drawdown_duration(dd), "strategy").join(time_to_recovery(dd), "strategy")
    ann = annualized_return(F.col("growth"), F.col("n"))
    root, loss = math.sqrt(YEAR), lambda c: r10(F.greatest(F.lit(0.0), -c))
    return x.select(
        "strategy", F.col("n").alias("n_sessions"), r10(ann).alias("annualized_return"), r10(F.coalesce("sd", F.lit(0.0)) * root).alias("annualized_volatility"), r10(ratio(F.col("mean"), F.col("sd")) * root).alias("sharpe"), r10(ratio(F.col("mean"), F.col("down")) * root).alias("sortino"),
        r10(F.when(F.col("mdd") < -EPS, ann / F.abs("mdd")).otherwise(0.0)).alias("calmar"), r10("mdd").alias("max_drawdown"), r10("best_day").alias("best_day"), r10("worst_day").alias("worst_day"), r10("positive_fraction").alias("positive_fraction"),
        "max_drawdown_duration", "time_to_recovery", r10("skew").alias("skewness"), r10("kurt").alias("excess_kurtosis"),
        loss(F.col("q95")).alias("var_95"), loss(F.coalesce("t95", "q95")).alias("cvar_95"), loss(F.col("q99")).alias("var_99"), loss(F.coalesce("t99", "q99")).alias("cvar_99"),
        cornish_fisher_value(0.95, *(F.col(c) for c in ("n", "mean", "sd", "skew", "kurt", "q95"))).alias("cornish_fisher_var_95"),
    )


def benchmark_stats(pairs: DataFrame) -> DataFrame:
    """Regression on the benchmark and relative statistics from sums: beta, alpha, its t, correlation, R2, tracking error, information ratio."""
    root = math.sqrt(YEAR)
    x = pairs.groupBy("strategy").agg(
        F.count("*").alias("n"), F.regr_slope("r", "b").alias("beta"), F.regr_intercept("r", "b").alias("a"), F.regr_sxx("r", "b").alias("sxx"), F.regr_syy("r", "b").alias("syy"), F.regr_sxy("r", "b").alias("sxy"),
        F.avg("b").alias("mb"), F.corr("r", "b").alias("corr"), F.stddev_samp(F.col("r") - F.col("b")).alias("sd"), F.avg(F.col("r") - F.col("b")).alias("active"),
    ).where("n >= 3")
    s2 = F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2)
    se = F.sqrt(s2 * (1 / F.col("n") + F.col("mb") ** 2 / F.col("sxx")))
    return x.select("strategy", F.col("n").alias("n_sessions"), F.round("beta", 8).alias("beta"), F.round(F.col("a") * YEAR, 8).alias("alpha_annualized"), F.round(ratio(F.col("a"), se), 6).alias("alpha_tstat"), F.round("corr", 8).alias("correlation"), F.round(F.col("corr") ** 2, 8).alias("r_squared"), F.round(F.col("sd") * root, 8).alias("tracking_error"), F.round(ratio(F.col("active") * YEAR, F.col("sd") * root), 8).alias("information_ratio"))


def capture_ratios(pairs: DataFrame) -> DataFrame:
    mean = lambda c, up: F.avg(F.when(F.col("b") > 0 if up else F.col("b") < 0, F.col(c)))
    x = pairs.groupBy("strategy").agg(mean("r", True).alias("ru"), mean("b", True).alias("bu"), mean("r", False).alias("rd"), mean("b", False).alias("bd"))
    out = lambda a, b: F.round(F.coalesce(F.when(F.col(b) != 0, F.col(a) / F.col(b)), F.lit(0.0)), 8)
    return x.select("strategy", out("ru", "bu").alias("up_capture"), out("rd", "bd").alias("down_capture"))


def psr(returns: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Probabilistic Sharpe ratio: (strategy, sharpe, psr). ``thresholds`` has one row with sr0."""
    m = moments(returns).withColumn("sr", ratio(F.col("mean"), F.col("sd")))
    m = m.withColumn("sr0", F.lit(0.0)) if thresholds is None else m.join(thresholds.select("sr0"), F.lit(True))
    den = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sr") + (F.col("kurt") + 2) / 4 * F.col("sr") ** 2))
    value = F.when(F.col("n") < 3, 0.0).otherwise(normal.cdf((F.col("sr") - F.col("sr0")) * F.sqrt(F.col("n") - 1) / den))
    return m.select("strategy", F.round("sr", 8).alias("sharpe"), F.round("sr0", 8).alias("threshold"), r10(value).alias("psr"))


def expected_max_sharpe(trials: DataFrame) -> DataFrame:
    """(sr0, n): expected best of N trials without skill. Quantiles of the normal are literals of each N up to 10,000, by a driver-side formula for the one N."""
    x = period_sharpe(trials).agg(F.stddev_samp("sharpe").alias("sd"), F.count("*").alias("n"))
    n = x.first()["n"]
    if n < 2:
        return x.select(F.lit(0.0).alias("sr0"), "n")
    q, g = NormalDist().inv_cdf, 0.5772156649015329
    return x.select(F.when(F.col("sd") > 0, F.col("sd") * ((1 - g) * q(1 - 1 / n) + g * q(1 - 1 / (n * math.e)))).otherwise(0.0).alias("sr0"), "n")


def deflated_sharpe(trials: DataFrame) -> DataFrame:
    return psr(trials, expected_max_sharpe(trials)).withColumnRenamed("psr", "dsr")


def pbo_logits(trials: DataFrame, splits: int = 10) -> DataFrame:
    """Combinatorially symmetric cross-validation: (combo, winner, logit) of each half of the blocks.

    Moments of (block, trial) are summed for every combination, so observations are read once.
    The winner is the first best by name; ranks of ties are averaged.
    """
    spark = trials.sparkSession
    sizes = trials.groupBy(F.col("strategy").alias("__of")).agg(F.count("*").alias("__n"))
    trials = blocks.numbered(trials, SERIES, "session", "__i").join(sizes, F.col("strategy").eqNullSafe(F.col("__of")))
    n, i = F.col("__n"), F.col("__i")
    big, extra = F.floor(n / splits), n % splits
    block = F.when(i < extra * (big + 1), F.floor(i / (big + 1))).otherwise(extra + F.floor((i - extra * (big + 1)) / F.greatest(big, F.lit(1))))
    m = trials.withColumn("block", block.cast("int")).groupBy("strategy", "block").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") ** 2).alias("q"))
    from itertools import combinations

    rows = [(c, b, b in half) for c, half in enumerate(combinations(range(splits), splits // 2)) for b in range(splits)]
    combos = F.broadcast(spark.createDataFrame(rows, "combo int, block int, inside boolean"))  # C(splits, splits / 2) * splits rows: a parameter's size
    x = m.join(combos, "block").groupBy("combo", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, var = F.col("s") / F.col("n"), (F.col("q") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1)
    x = x.withColumn("perf", F.when(var > 1e-18, mean / F.sqrt(var)).otherwise(0.0))
    both = x.groupBy("combo", "strategy").agg(F.max(F.when(F.col("inside"), F.col("perf"))).alias("is_"), F.max(F.when(~F.col("inside"), F.col("perf"))).alias("oos"))
    c = Window.partitionBy("combo")
    both = both.withColumn("first", F.row_number().over(c.orderBy(F.desc("is_"), "strategy"))).withColumn("rank", F.rank().over(c.orderBy("oos")) + (F.count("*").over(Window.partitionBy("combo", "oos")) - 1) / 2).withColumn("trials", F.count("*").over(c))
    omega = F.least(F.greatest(F.col("rank") / (F.col("trials") + 1), F.lit(1e-9)), F.lit(1 - 1e-9))
    return both.where("first = 1").select("combo", F.col("strategy").alias("winner"), F.round(F.log(omega / (1 - omega)), 8).alias("logit"))


def overfitting_summary(trials: DataFrame, splits: int = 10) -> DataFrame:
    logits = pbo_logits(trials, splits).agg(F.count("*").alias("combinations"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.percentile("logit", 0.5).alias("logit_median"))
    best = deflated_sharpe(trials).orderBy(F.desc("sharpe"), "strategy").limit(1)
    return logits.join(best, F.lit(True))


def downsample(curve: DataFrame, points: int = 320) -> DataFrame:
    """Every ceil(n / points)-th row of each series, and its last."""
    sizes = curve.groupBy(F.col("strategy").alias("__of")).agg(F.count("*").alias("__n"))
    x = blocks.numbered(curve, SERIES, "session", "__i").join(sizes, F.col("strategy").eqNullSafe(F.col("__of")))
    return x.where(f"__i % cast(ceil(__n / {points}) as int) = 0 or __i = __n - 1").drop("__n", "__i", "__of")
