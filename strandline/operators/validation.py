"""Quality rules over bars: each emits (seq, code, severity, message) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "vwap")


def ohlc_violations(bars: DataFrame, source: str | None = None) -> DataFrame:
    """Bars that break a row rule, with their sorted reasons; null fields break the rule they stand in."""
    bad = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    rules = [bad(F.col(c) > 0, f"{c}_not_positive") for c in PRICES] + [bad(F.col(c) >= 0, f"{c}_negative") for c in ("volume", "trade_count")]
    rules += [bad(F.col("high") >= F.greatest("open", "low", "close"), "high_below_others"), bad(F.col("low") <= F.least("open", "high", "close"), "low_above_others")]
    if source:
        rules.append(bad(F.length(F.trim(source)) > 0, "source_empty"))
    return bars.withColumn("reasons", F.array_join(F.sort_array(F.array_compact(F.array(*rules))), ",")).where("reasons <> ''")


def normalize_symbols(df: DataFrame, symbol: str, country: str) -> DataFrame:
    """Trimmed, upper-case symbols and whether they are valid US ones."""
    s = F.upper(F.trim(symbol))
    return df.withColumn("symbol", s).withColumn("valid", F.coalesce(F.col("symbol").rlike("^[A-Z][A-Z0-9.-]{0,14}$") & (F.col(country) == "US"), F.lit(False)))


def universe_duplicates(universe: DataFrame) -> DataFrame:
    return universe.groupBy("universe_version", "symbol").agg(F.count("*").alias("n")).where("n > 1 or trim(universe_version) = ''")


def _issue(df: DataFrame, seq: int, code: str, message: Column) -> DataFrame:
    return df.select(F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit("block").alias("severity"), message.alias("message"))


def empty_input(bars: DataFrame) -> DataFrame:
    return _issue(bars.agg(F.count("*").alias("n")).where("n = 0"), 1, "empty_input", F.lit("no bars"))


def symbol_outside_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return _issue(bars.join(universe, "symbol", "left_anti").groupBy("symbol").count(), 2, "symbol_outside_universe", F.col("symbol"))


def missing_universe_symbol(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return _issue(universe.join(bars, "symbol", "left_anti").select("symbol").distinct(), 3, "missing_universe_symbol", F.col("symbol"))


def duplicate_bars(bars: DataFrame, sample: int = 5) -> DataFrame:
    """Repeated (symbol, session) keys: their number, and the first ``sample`` in order."""
    return bars.groupBy("symbol", "session").agg(F.count("*").alias("n")).where("n > 1").orderBy("symbol", "session").limit(sample)


def unsorted_bars(rows: DataFrame, row_no: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose (session, symbol) is less than that of the row before. DataFrames have no order, so ``row_no`` gives it; ``by`` splits independent inputs."""
    w = Window.partitionBy(*by).orderBy(row_no)
    key = F.struct("session", "symbol")
    return rows.withColumn("before", F.lag(key).over(w)).where(F.col("before") > key).drop("before")


def _any_unsorted(bars: DataFrame, row_no: str | None, block: int = 1 << 20) -> DataFrame:
    """One row if some row is less than one before it. Blocks of row numbers are compared each in its own task, their ends with each other."""
    if row_no is None:
        return bars.where("false").select(F.lit(1).alias("n"))
    key = F.struct("session", "symbol")
    rows = bars.select(F.floor(F.col(row_no) / block).alias("block"), F.col(row_no).alias("no"), key.alias("key"))
    inside = rows.withColumn("before", F.lag("key").over(Window.partitionBy("block").orderBy("no"))).where("before > key").select(F.lit(1).alias("n"))
    ends = rows.groupBy("block").agg(F.min_by("key", "no").alias("first"), F.max_by("key", "no").alias("last"))
    across = ends.withColumn("before", F.lag("last").over(Window.orderBy("block"))).where("before > first").select(F.lit(1).alias("n"))
    return inside.unionByName(across).limit(1)


def non_finite_values(bars: DataFrame) -> DataFrame:
    """(field, n) of fields with null, NaN or infinite values."""
    fields = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in PRICES]))
    return bars.select(fields).where("value is null or isnan(value) or abs(value) = double('infinity')").groupBy("field").agg(F.count("*").alias("n"))


def latest_session_mismatch(bars: DataFrame, expected: str) -> DataFrame:
    got = bars.agg(F.max("session").alias("latest"))
    return _issue(got.where(~F.col("latest").eqNullSafe(F.lit(expected).cast("date"))), 7, "latest_session_mismatch", F.coalesce(F.col("latest").cast("string"), F.lit("none")))


def incomplete_latest_session(bars: DataFrame, universe: DataFrame, expected: str) -> DataFrame:
    last = bars.where(F.col("session") == F.lit(expected).cast("date"))
    return _issue(universe.join(last, "symbol", "left_anti").select("symbol").distinct(), 8, "incomplete_latest_session", F.col("symbol"))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, missing, first_gap): calendar sessions (session, session_idx) inside a symbol's own range without a bar.

    Gaps between a symbol's neighbouring bars are differences of their numbers in the calendar; no range is joined. Bars on days off the calendar are passed over.
    """
    on = bars.select("symbol", "session").distinct().join(calendar.select("session", "session_idx"), "session")
    gap = F.col("session_idx") - F.lag("session_idx").over(Window.partitionBy("symbol").orderBy("session_idx")) - 1
    gaps = on.withColumn("gap", gap).where("gap > 0").groupBy("symbol").agg(F.sum("gap").alias("missing"), F.min(F.col("session_idx") - F.col("gap")).alias("session_idx"))
    return gaps.join(calendar.select("session_idx", F.col("session").alias("first_gap")), "session_idx").select("symbol", "missing", "first_gap")


def quality_report(bars: DataFrame, universe: DataFrame, calendar: DataFrame, expected: str, row_no: str | None = None) -> DataFrame:
    """All issues in rule order with the gate ``blocked``; one row of code ``ok`` when there are none.

    Nothing else is reported for an empty input, and the eighth rule only when the latest session is the expected one. The order of rows is judged by ``row_no``, if it is given.
    Each rule reads ``bars`` for itself: pass a written table.
    """
    n = bars.agg(F.count("*").alias("n"), F.max("session").alias("latest"))
    dup = bars.groupBy("symbol", "session").count().where("count > 1")
    rules = (
        symbol_outside_universe(bars, universe)
        .unionByName(missing_universe_symbol(bars, universe))
        .unionByName(_issue(dup, 4, "duplicate_bar", F.concat_ws(" ", "symbol", "session")))
        .unionByName(_issue(_any_unsorted(bars, row_no), 5, "unsorted_bars", F.lit("bars are not sorted by (session, symbol)")))
        .unionByName(_issue(non_finite_values(bars), 6, "non_finite_value", F.col("field")))
        .unionByName(latest_session_mismatch(bars, expected))
        .unionByName(incomplete_latest_session(bars.join(n.where(F.col("latest") == F.lit(expected).cast("date")), F.lit(True), "left_semi"), universe, expected).join(n.where(F.col("latest") == F.lit(expected).cast("date")), F.lit(True), "left_semi"))
        .unionByName(_issue(missing_sessions(bars, calendar), 9, "missing_session", F.concat_ws(" ", "symbol", "missing", "first_gap")))
    )
    issues = empty_input(bars).unionByName(rules.join(n.where("n > 0"), F.lit(True), "left_semi"))
    gate = issues.agg(F.coalesce(F.max((F.col("severity") == "block").cast("int")), F.lit(0)).alias("blocked"))
    return gate.join(issues, F.lit(True), "left").select(F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("code", F.lit("ok")).alias("code"), "severity", "message", (F.col("blocked") == 1).alias("blocked")).orderBy("seq", "message")
