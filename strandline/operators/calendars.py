"""Trading calendars as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks


def build(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None, early: DataFrame | None = None, close_hour: int = 21) -> DataFrame:
    """(session, session_idx, close_ts): weekdays but holidays; the hour of close is UTC, three hours less for early closes. One row a day, so one window numbers them."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session")).where(F.dayofweek("session").between(2, 6))
    if holidays is not None:
        days = days.join(holidays.select("session"), "session", "left_anti")
    close = F.lit(close_hour)
    if early is not None:
        days = days.join(early.select("session", F.lit(True).alias("early")), "session", "left")
        close = F.when(F.col("early"), close_hour - 3).otherwise(close_hour)
    return days.select("session", F.row_number().over(Window.orderBy("session")).alias("session_idx"), (F.col("session").cast("timestamp") + F.make_interval(hours=close)).alias("close_ts"))


def observed(bars: DataFrame) -> DataFrame:
    """The calendar of a panel: its distinct sessions."""
    x = blocks.numbered(bars.select("session").distinct(), [], "session", "session_idx")
    return x.withColumn("session_idx", (F.col("session_idx") + 1).cast("int"))


def between(calendar: DataFrame, start: str, end: str) -> DataFrame:
    return calendar.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def last_completed(times: DataFrame, calendar: DataFrame, ts: str) -> DataFrame:
    """As-of join: for each time the latest session whose close is not after it; null if none is.

    Times and closes of one month are sorted together, for a running maximum; earlier months give their last session.
    """
    month = lambda c: F.date_trunc("month", c)
    both = times.select(F.col(ts).alias("at"), F.lit(None).cast("date").alias("session"), F.lit(1).alias("kind")).unionByName(
        calendar.select(F.col("close_ts").alias("at"), "session", F.lit(0).alias("kind"))
    ).withColumn("month", month("at"))
    inside = F.max("session").over(Window.partitionBy("month").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    months = times.select(month(ts).alias("month")).distinct().join(calendar.groupBy(month("close_ts").alias("m")).agg(F.max("session").alias("s")), F.col("m") < F.col("month"), "left").groupBy("month").agg(F.max("s").alias("earlier"))
    return both.withColumn("inside", inside).where("kind = 1").join(months, "month", "left").select(F.col("at").alias(ts), F.coalesce("inside", "earlier").alias("last_session"))


def embargo_start(calendar: DataFrame, sessions: int) -> DataFrame:
    """(session, embargo_start): the session such that [it, session] holds exactly ``sessions`` sessions; null near the calendar's start."""
    other = calendar.select(F.col("session").alias("embargo_start"), (F.col("session_idx") + (sessions - 1)).alias("session_idx"))
    return calendar.join(other, "session_idx", "left").select("session", "embargo_start")


def completeness(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, present, expected, completeness, excluded) within each symbol's own range."""
    on = bars.select("symbol", "session").distinct().join(calendar.select("session", "session_idx"), "session", "left")
    due = on.groupBy("symbol").agg(F.count("*").alias("present"), (F.max("session_idx") - F.min("session_idx") + 1).cast("long").alias("expected"))
    return due.select("symbol", "present", "expected", F.round(F.col("present") / F.col("expected"), 10).alias("completeness"), F.greatest(F.col("expected") - F.col("present"), F.lit(0)).alias("excluded"))
