"""Embargoed walk-forward ridge forecasts from running moment sums.

Training rows of a decision are those whose label ended before its embargo. For one decision
calendar that is a prefix in the order of label ends: sums of all products are
aggregated for each label end, then run over sessions, and picked as of the embargo.
So rows are read once for all decisions and penalties.
Running totals are taken in ranges of sessions (``functions.blocks``), never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.linear import matrix_of
from . import calendars, features

EMBARGO = 21
MINIMUM = 504
Z = tuple(f"z_{c}" for c in features.FEATURES)


def usable(rows: DataFrame) -> DataFrame:
    """Rows that may train: not missing, with a label and its end."""
    return rows.where("not missing and forward_return_21 is not null and label_end_session is not null")


def decisions(rows: DataFrame, embargo: int = EMBARGO) -> DataFrame:
    """(decision_session, embargo_start) of every session of a panel; null near its start."""
    cal = calendars.observed(rows.select(F.col("decision_session").alias("session")))
    return calendars.embargo_start(cal, embargo).withColumnRenamed("session", "decision_session")


def label_sums(rows: DataFrame) -> DataFrame:
    """Running totals by label end: (label_end_session, rows, sessions, first, last), one row a session."""
    per = usable(rows).groupBy("label_end_session").agg(F.count("*").alias("rows"), F.min("decision_session").alias("lo"), F.max("decision_session").alias("hi"))
    out = blocks.running(per, [], "label_end_session", {"r": (F.col("rows"), "sum"), "training_start": (F.col("lo"), "min"), "training_end": (F.col("hi"), "max")})
    return out.select("label_end_session", F.col("r").alias("rows"), "training_start", "training_end")


def training_split(rows: DataFrame, embargo: int = EMBARGO) -> DataFrame:
    """(decision_session, symbol, training_rows, training_start, training_end): what each decision trains on of each symbol, if anything.

    A symbol's rows are sorted once by the end of their label; what ended before a decision's embargo is a running total. For the rows themselves see ``training_membership``.
    """
    t = usable(rows).select("symbol", F.col("label_end_session").alias("at"), F.lit(1).alias("kind"), F.col("decision_session").alias("s"), F.lit(None).cast("date").alias("decision_session"))
    d = decisions(rows, embargo).where("embargo_start is not null")
    # A row for each symbol and decision: the size of the result.
    due = t.select("symbol").distinct().crossJoin(d.select(F.col("embargo_start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("date").alias("s"), "decision_session"))
    figures = {"training_rows": (F.when(F.col("s").isNotNull(), 1).cast("long"), "sum"), "training_start": (F.col("s"), "min"), "training_end": (F.col("s"), "max")}
    run = blocks.running(t.unionByName(due), ["symbol"], "at", figures, then=("kind",))
    return run.where("decision_session is not null and training_rows > 0").select("decision_session", "symbol", "training_rows", "training_start", "training_end")


def training_membership(rows: DataFrame, embargo: int = EMBARGO) -> DataFrame:
    """(symbol, training_session, first_decision) of every usable row: it trains first_decision and every later one, and none if that is null.

    Embargoes rise with their decisions, so this states the split of every decision in one row a training row.
    """
    t = usable(rows).select("symbol", F.col("decision_session").alias("training_session"), "label_end_session")
    d = decisions(rows, embargo).where("embargo_start is not null")
    # One row a session: the first decision of which the embargo starts after a label end.
    events = t.select(F.col("label_end_session").alias("at")).distinct().withColumn("decision_session", F.lit(None).cast("date")).withColumn("kind", F.lit(1)).unionByName(
        d.select(F.col("embargo_start").alias("at"), "decision_session").withColumn("kind", F.lit(0))
    )
    events = blocks.running(events, [], "at", {"first_decision": (F.col("decision_session"), "min")}, then=("kind",), descending=True)
    first = events.where("kind = 1").select(F.col("at").alias("label_end_session"), "first_decision")
    return t.join(first, "label_end_session").select("symbol", "training_session", "first_decision")


def sufficiency(rows: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """(decision_session, training_sessions, status): distinct training sessions of every decision.

    A session counts from its earliest label end on, so the count is a running sum.
    """
    first = usable(rows).groupBy("decision_session").agg(F.min("label_end_session").alias("end")).groupBy("end").agg(F.count("*").alias("n"))
    events = first.select(F.col("end").alias("at"), "n", F.lit(None).cast("date").alias("decision_session"), F.lit(1).alias("kind")).unionByName(
        decisions(rows).select(F.col("embargo_start").alias("at"), F.lit(0).cast("long").alias("n"), "decision_session", F.lit(0).alias("kind"))
    )
    # A label end counts only if it lies before the embargo: at equal dates decisions come first.
    out = blocks.running(events, [], "at", {"training_sessions": (F.col("n"), "sum")}, then=("kind",)).where("decision_session is not null")
    return out.select("decision_session", "training_sessions", F.when(F.col("training_sessions") >= minimum, "ok").otherwise("blocked").alias("status"))


def _names(n: int) -> list[str]:
    return [f"g{i}_{j}" for i in range(n) for j in range(i, n)]


def score_sums(rows: DataFrame) -> DataFrame:
    """(label_end_session, g0_0, ...): what the rows of each label end add to the sums of products of (1, z-scores, label) of every later decision.

    A decision's z-scores are those among the rows of a session that it may see. Where symbols end their labels of one session
    at different times (a panel with gaps), more rows come in with each label end, and the scores of all the session's rows move.
    So raw moments run over the label ends inside each session, each state is turned into sums of products of z-scores, and
    a label end adds the difference to the state before it. Rows are read once; a session has one state a label end. Values are
    taken relative to the session's least, so that a column without spread has exactly none.
    """
    u = usable(finite_rows(rows)).where("finite")
    fs, k = features.FEATURES, len(features.FEATURES)
    least = u.groupBy("decision_session").agg(*[F.min(c).alias(f"__{c}") for c in fs])
    cols = [F.lit(1.0), *[F.col(c) - F.col(f"__{c}") for c in fs], F.col("forward_return_21")]
    per = u.join(least, "decision_session").groupBy("decision_session", "label_end_session").agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k + 2) for j in range(i, k + 2)])
    # States of one session: as many as it has label ends, one for each symbol at most.
    w = Window.partitionBy("decision_session").orderBy("label_end_session")
    run = per.select("decision_session", "label_end_session", *[F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in _names(k + 2)])
    n, g = F.col("g0_0"), lambda i, j: F.col(f"g{min(i, j)}_{max(i, j)}")
    sd = [F.sqrt(F.greatest(g(i, i) - g(0, i) * g(0, i) / n, F.lit(0.0)) / (n - 1)) for i in range(1, k + 1)]
    state = run.withColumns({f"__sd{i}": F.when(n > 1, sd[i - 1]) for i in range(1, k + 1)})
    spread = lambda i: F.when(F.col(f"__sd{i}") > 1e-12, F.col(f"__sd{i}"))
    out = {}
    for i in range(k + 2):
        for j in range(i, k + 2):
            if i in (0, k + 1) and j in (0, k + 1):
                value = g(i, j)
            elif i == 0:
                value = F.lit(0.0)
            elif j == k + 1:
                value = (g(i, j) - g(0, i) * g(0, j) / n) / spread(i)
            else:
                value = (g(i, j) - g(0, i) * g(0, j) / n) / spread(i) / spread(j)
            out[f"g{i}_{j}"] = F.coalesce(value, F.lit(0.0))
    scored = state.select("decision_session", "label_end_session", *[v.alias(c) for c, v in out.items()])
    added = scored.select("label_end_session", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))).alias(c) for c in out])
    return added.groupBy("label_end_session").agg(*[F.sum(c).alias(c) for c in out])


def decision_sums(rows: DataFrame, every: int = 1) -> DataFrame:
    """(decision_session, g array): the sums of products of every ``every``-th decision with training rows, over all of them."""
    names = _names(len(features.FEATURES) + 2)
    d = blocks.numbered(decisions(rows), [], "decision_session", "i").where(f"i % {every} = 0 and embargo_start is not null")
    events = score_sums(rows).select(F.col("label_end_session").alias("at"), F.lit(None).cast("date").alias("decision_session"), F.lit(1).alias("kind"), *names).unionByName(
        d.select(F.col("embargo_start").alias("at"), "decision_session", F.lit(0).alias("kind"), *[F.lit(0.0).alias(n) for n in names])
    )
    sums = blocks.running(events, [], "at", {f"s{n}": (F.col(n), "sum") for n in names}, then=("kind",))
    return sums.select("decision_session", F.array(*[f"s{n}" for n in names]).alias("g")).where("decision_session is not null and g[0] > 0.5")


def ridge_coefficients(rows: DataFrame, alphas: DataFrame, every: int = 1) -> DataFrame:
    """(decision_session, alpha, n, intercept, beta array) of every ``every``-th decision with training rows.

    rows: feature rows of any panel, with or without gaps. The sums of one decision are 36 numbers; the solve of 6 x 6 systems is Arrow-batched.
    """
    sums = decision_sums(rows, every)
    k = len(Z) + 1

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for day, alpha, g in zip(batch["decision_session"], batch["alpha"], batch["g"]):
                m = matrix_of(g, k + 1)
                n, mean, my = m[0, 0], m[0, 1:k] / m[0, 0], m[0, k] / m[0, 0]
                a = m[1:k, 1:k] - n * np.outer(mean, mean) + alpha * np.eye(k - 1)
                beta = np.linalg.lstsq(a, m[1:k, k] - n * mean * my, rcond=None)[0]
                out.append((day, alpha, round(n), float(my - mean @ beta), beta.tolist()))
            yield pd.DataFrame(out, columns=["decision_session", "alpha", "n", "intercept", "beta"])

    return sums.crossJoin(alphas).select("decision_session", "alpha", "g").mapInPandas(solve, "decision_session date, alpha double, n long, intercept double, beta array<double>")


def forecasts(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(alpha, decision_session, symbol, forecast) of each decision's own cross-section, missing rows left out."""
    x = rows.where("not missing").join(coefficients, "decision_session")
    dot = sum((F.col(z) * F.col("beta")[i] for i, z in enumerate(Z)), F.col("intercept"))
    return x.select("alpha", "decision_session", "symbol", F.round(dot, 10).alias("forecast"))


def _finite(*columns: str) -> Column:
    return F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def finite_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``finite``: whether the features and, where it is known, the label are finite numbers. Models leave other rows out of their sums."""
    return rows.withColumn("finite", F.coalesce(_finite(*features.FEATURES), F.lit(False)) & F.coalesce(_finite("forward_return_21"), F.lit(True)))


def finite_series(df: DataFrame, column: str) -> DataFrame:
    """``df``, which fails when a null, NaN or infinite value of ``column`` is read."""
    ok = F.coalesce(_finite(column), F.lit(False))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} is not finite: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("double")))


def finiteness(rows: DataFrame) -> DataFrame:
    """(decision_session, cross_section, bad_cross_section, bad_training): rows of each decision, those of them that are not finite, and such rows among what it trains on."""
    f = finite_rows(rows)
    own = f.where("not missing").groupBy("decision_session").agg(F.count("*").alias("cross_section"), F.count_if(~_finite(*features.FEATURES)).alias("bad_cross_section"))
    bad = usable(f).where("not finite").groupBy(F.col("label_end_session").alias("at")).agg(F.count("*").alias("n"))
    events = bad.select("at", "n", F.lit(None).cast("date").alias("decision_session"), F.lit(1).alias("kind")).unionByName(
        decisions(rows).where("embargo_start is not null").select(F.col("embargo_start").alias("at"), F.lit(0).cast("long").alias("n"), "decision_session", F.lit(0).alias("kind"))
    )
    run = blocks.running(events, [], "at", {"bad_training": (F.col("n"), "sum")}, then=("kind",)).where("decision_session is not null")
    out = decisions(rows).select("decision_session").join(own, "decision_session", "left").join(run.select("decision_session", "bad_training"), "decision_session", "left")
    return out.select("decision_session", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cross_section", "bad_cross_section", "bad_training")])


def forecast_batches(rows: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Metadata of every decision's batch: embargo, training range, rows, sessions and why it is blocked, by the first gate that it fails."""
    d, s = decisions(rows), sufficiency(rows, minimum)
    sums = label_sums(rows)
    events = sums.select(F.col("label_end_session").alias("at"), F.lit(None).cast("date").alias("decision_session"), F.lit(1).alias("kind"), F.struct("rows", "training_start", "training_end").alias("s")).unionByName(
        d.where("embargo_start is not null").select(F.col("embargo_start").alias("at"), "decision_session", F.lit(0).alias("kind"), F.lit(None).cast("struct<rows:bigint,training_start:date,training_end:date>").alias("s"))
    )
    picked = blocks.running(events.withColumnRenamed("s", "own"), [], "at", {"s": (F.col("own"), "last")}, then=("kind",)).where("decision_session is not null").select("decision_session", "s.*")
    out = d.join(s, "decision_session").join(picked, "decision_session", "left").join(finiteness(rows), "decision_session")
    why = F.when(F.col("status") == "blocked", "insufficient_training_sessions").when(F.col("cross_section") == 0, "empty_cross_section").when(F.col("bad_training") > 0, "non_finite_training").when(F.col("bad_cross_section") > 0, "non_finite_prediction")
    return out.select("decision_session", "embargo_start", "training_start", "training_end", F.coalesce("rows", F.lit(0)).alias("training_rows"), "training_sessions", why.alias("blocked_reason"))


def schedule(sessions: DataFrame, warmup: int, cadence: int = 1) -> DataFrame:
    """(decision_session, execution_session, retrain): decisions after the warm-up, executed at the next session."""
    x = blocks.windowed(sessions.select("session"), [], "session", lambda w: [{"execution_session": F.lead("session").over(w())}], 0, 1, place="i").withColumn("i", (F.col("i") + 1).cast("int"))
    return x.where(f"i > {warmup} and execution_session is not null").select(F.col("session").alias("decision_session"), "execution_session", (((F.col("i") - warmup - 1) % cadence) == 0).alias("retrain"))


def held_weights(grid: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of the last decision that has any, for every session of ``grid``: (session, weights map). One map a session."""
    maps = weights.groupBy("decision_session").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "weight")))).alias("weights"))
    x = grid.select(F.col("session").alias("decision_session")).distinct().join(maps, "decision_session", "left")
    x = blocks.running(x.withColumnRenamed("weights", "own"), [], "decision_session", {"weights": (F.col("own"), "last")})
    return x.where("weights is not null").select(F.col("decision_session").alias("session"), "weights")
