"""Point-in-time features: windows over blocks of a symbol's bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks

HORIZON = 21
WARM = 126
FEATURES = ("return_21", "return_63", "return_126", "volatility_21", "sma_distance_100", "dollar_volume_20")


def raw_features(bars: DataFrame) -> DataFrame:
    """Bars with features (null until their window is full), label and its end; the number of the bar in its symbol.

    Windows are taken inside blocks of a symbol's bars with the ``WARM`` + 1 bars before and the ``HORIZON`` bars after
    them, so the bars of one long symbol spread over many tasks.
    """

    def columns(w):
        lag = lambda n: F.lag("close", n).over(w())
        full = lambda value, of, n: F.when(F.count(of).over(w(n - 1)) == n, value)
        dollars = F.col("close") * F.col("volume")
        out = {f"return_{n}": F.col("close") / lag(n) - 1 for n in (21, 63, 126)}
        out["volatility_21"] = full(F.stddev_samp("log_return").over(w(20)) * math.sqrt(252), "log_return", 21)
        out["sma_distance_100"] = full(F.col("close") / F.avg("close").over(w(99)) - 1, "close", 100)
        out["dollar_volume_20"] = full(F.avg(dollars).over(w(19)), dollars, 20)
        out["forward_return_21"] = F.lead("close", HORIZON).over(w()) / F.col("close") - 1
        out["label_end_session"] = F.lead("session", HORIZON).over(w())
        return [{"log_return": F.log(F.col("close") / lag(1))}, out]

    x = blocks.windowed(bars, ["symbol"], "session", columns, WARM + 1, HORIZON, place="bar_no")
    return x.withColumn("bar_no", (F.col("bar_no") + 1).cast("int"))


def feature_rows(bars: DataFrame, snapshot_id: str, horizon: int = HORIZON) -> DataFrame:
    """The feature table: values 0.0 on the first 126 bars (flag ``missing``) and where they are not finite; labels stay on missing rows."""
    if horizon != HORIZON:
        raise ValueError("the horizon is 21 sessions")
    x = raw_features(bars)
    missing = F.col("bar_no") <= WARM

    def settled(c: str) -> Column:
        v = F.col(c)
        return F.when(missing | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.round(v, 8)).alias(c)

    return x.select("symbol", F.col("session").alias("decision_session"), *[settled(c) for c in FEATURES], F.round("forward_return_21", 8).alias("forward_return_21"), "label_end_session", missing.alias("missing"), F.lit(snapshot_id).alias("snapshot_id"))


def leakage(bars: DataFrame, cut: str) -> DataFrame:
    """Feature rows up to ``cut`` that change when later closes are altered; none when features are point-in-time."""
    cols = ["symbol", "decision_session", *FEATURES, "missing"]
    upto = F.col("decision_session") <= F.lit(cut).cast("date")
    later = bars.withColumn("close", F.when(F.col("session") > F.lit(cut).cast("date"), F.col("close") * 3).otherwise(F.col("close")))
    a, b = (feature_rows(x, "audit").where(upto).select(*cols) for x in (bars, later))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def xs_zscore(rows: DataFrame, columns: tuple[str, ...] = FEATURES, by: str = "decision_session") -> DataFrame:
    """Cross-sectional z-scores (sample deviation) within each session; 0 without spread or alone. A session has one row a symbol."""
    w = Window.partitionBy(by)

    def z(c: str) -> Column:
        sd = F.stddev_samp(c).over(w)
        return F.when(sd > 1e-12, (F.col(c) - F.avg(c).over(w)) / sd).otherwise(0.0).alias(f"z_{c}")

    return rows.select("*", *[z(c) for c in columns])
