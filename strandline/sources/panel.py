"""Trade-like rows as daily bars, and the panels made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks
from .tables import written

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, session, price, qty, ORDER...) of every line item; symbol is the supplier's region. Dimensions are left to the optimizer to broadcast by their size."""
    t = lambda n: table(spark, sf_dir, n)
    x = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    price = F.round(F.col("p_retailprice") * (1 - F.col("l_discount")), 4)
    return x.select(F.col("r_name").alias("symbol"), F.to_date("l_shipdate").alias("session"), price.alias("price"), F.col("l_quantity").alias("qty"), *ORDER)


def bars_of(rows: DataFrame, keys: tuple[str, ...] = ("symbol", "session"), order: tuple[str, ...] = ORDER) -> DataFrame:
    """One bar for each key: first, highest, lowest and last price by a total order, summed volume, volume-weighted price, count. Partial aggregates keep one row for each key and task."""
    o = F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"),
        F.sum("qty").alias("volume"), F.round(F.sum(F.col("price") * F.col("qty")) / F.sum("qty"), 8).alias("vwap"), F.count("*").alias("trade_count"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(trades(spark, sf_dir))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(trades(spark, sf_dir).withColumn("session", F.to_date(F.date_trunc("week", "session"))))


def scan(bars: DataFrame, universe: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of the universe's symbols between two dates, in (session, symbol) order."""
    return bars.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(universe.select("symbol").distinct(), "symbol", "left_semi").orderBy("session", "symbol")


def rectangular(bars: DataFrame) -> DataFrame:
    """Valid bars of the sessions that every symbol has; prices to 4 places, high and low repaired, vwap as the typical price."""
    ok = bars.dropna(subset=["open", "high", "low", "close", "volume"]).where("open > 0 and high > 0 and low > 0 and close > 0 and volume > 0")
    symbols = ok.agg(F.count_distinct("symbol").alias("n"))
    full = ok.groupBy("session").agg(F.count_distinct("symbol").alias("have")).join(symbols, F.col("have") == F.col("n"), "left_semi")
    r = lambda c: F.round(c, 4)
    out = ok.join(full, "session", "left_semi").withColumns({"open": r("open"), "close": r("close"), "high": r(F.greatest("open", "high", "low", "close")), "low": r(F.least("open", "high", "low", "close"))})
    return out.select("symbol", "session", "open", "high", "low", "close", "volume", F.round((F.col("high") + F.col("low") + F.col("close")) / 3, 4).alias("vwap"), "trade_count")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as a universe dimension."""
    return table(spark, sf_dir, "region").select(F.lit("regions-v1").alias("universe_version"), F.col("r_name").alias("symbol"), F.lit("etf").alias("asset_type"), F.lit("US").alias("country"))


def close_returns(bars: DataFrame) -> DataFrame:
    """(strategy, session, ret): close to close for each symbol, the first row dropped. The closes are written once, as both levels of the scan read them."""
    x = blocks.previous(written(bars.select("symbol", "session", "close"), "closes"), ["symbol"], "session", "close", "before")
    return x.select(F.col("symbol").alias("strategy"), "session", F.round(F.col("close") / F.col("before") - 1, 10).alias("ret")).where("ret is not null")
