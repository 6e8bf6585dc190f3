"""The report: one nested document a series, from the blocks that the other queries compute."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linear
from ..operators import analytics as an
from ..operators import calendars as cal
from ..operators import registry as reg
from ..operators import report
from ..operators import targets as tgt
from ..sources import ingest, panel
from . import analytics_queries as aq
from . import desk_queries as dq
from . import model_queries as mq

Q, SQL = {}, {}
#: Runs that the report lists.
PLACES = 50
INITIAL = 1e6


def blocks(spark, d):
    """Every block of the report, by name: of each series, of its market, and of the desk as a whole."""
    bars = ingest.written(panel.daily_bars(spark, d), "bars")
    r = ingest.written(aq.finite_series(panel.close_returns(bars), "ret"), "returns")
    bench = r.where(F.col("strategy") == aq.BENCH)
    stats = ingest.written(an.performance_summary(r), "stats")
    rel = linear.with_pvalue(an.benchmark_stats(an.aligned(r.where(F.col("strategy") != aq.BENCH), bench)), "alpha_tstat", F.col("n_sessions") - 2, "alpha_pvalue")
    rel = ingest.written(rel.withColumn("alpha_pvalue", F.round("alpha_pvalue", 8)), "relative")
    market = an.growth_curve(bench, INITIAL).select("session", F.col("equity").alias("market"))
    rolling = an.rolling_sharpe(r).select("strategy", "session", "rolling_sharpe")
    curve = an.drawdowns(r).join(rolling, ["strategy", "session"]).join(market, "session", "left")
    curve = ingest.written(an.downsample(curve.select("strategy", "session", "equity", "dd", "rolling_sharpe", "market")), "curve")
    by_year = an.compounded(r, "year")
    years = by_year.join(by_year.where(F.col("strategy") == aq.BENCH).select("year", F.col("ret").alias("b")), "year", "left")
    logits = ingest.written(an.pbo_logits(r), "logits")
    last = curve.groupBy("strategy").agg(F.max_by("equity", "session").alias("e"))
    headline = stats.join(last, "strategy").join(rel, "strategy", "left").select(
        "strategy", "sharpe", "annualized_return", "annualized_volatility", "max_drawdown", "sortino", "calmar", "beta", "alpha_annualized", "alpha_tstat", "alpha_pvalue", "information_ratio", F.round(F.col("e") * INITIAL, 2).alias("final_equity"), F.round("e", 4).alias("total_return_multiple")
    )
    f = mq._signals(spark, d, ingest.written(panel.rectangular(bars), "panel"))
    latest = f.agg(F.max("decision_session").alias("decision_session"))
    w = ingest.written(tgt.quantised(tgt.constrained(tgt.desired(f.join(latest, "decision_session", "left_semi"), mq.KEY), mq.KEY)), "weights")
    classes = spark.createDataFrame([("ASIA", "Emerging"), ("AMERICA", "Developed"), ("EUROPE", "Developed")], "symbol string, asset_class string")
    ranked = reg.ranking(dq._runs(spark, d), "study").where("rank = 1").orderBy(F.desc("robust_sharpe"), "run_id").limit(PLACES)
    checks = dq._checks(spark, d).groupBy("seq", "code").agg(F.count_if(F.col("status") == "pass").alias("pass"), F.count_if(F.col("status") == "block").alias("block"))
    meta = r.groupBy("strategy").agg(F.min("session").alias("start_session"), F.max("session").alias("end_session"), F.count("*").alias("n_sessions")).withColumn("benchmark", F.lit(aq.BENCH))
    date = F.col("session").cast("string").alias("date")
    obj, rows, s = report.as_object, report.as_list, "strategy"
    return r.select(s).distinct(), {
        "meta": obj(meta, s),
        "headline": obj(headline, s),
        "performance": obj(stats, s),
        "equity_curve": rows(curve.select(s, date, F.round(F.col("equity") * INITIAL, 2).alias("strategy_equity"), F.round("market", 2).alias("benchmark_equity")), [F.col("date")], s),
        "drawdown": rows(curve.select(s, date, F.round("dd", 6).alias("dd")), [F.col("date")], s),
        "rolling_sharpe": rows(curve.where("rolling_sharpe is not null").select(s, date, F.round("rolling_sharpe", 4).alias("value")), [F.col("date")], s),
        "histogram": rows(an.histogram(r), [F.col("bin")], s),
        "monthly": rows(an.compounded(r, "year", "month").withColumn("ret", F.round("ret", 6)), [F.col("year"), F.col("month")], s),
        "yearly": rows(years.select(s, "year", F.round("ret", 4).alias("ret"), F.round(F.coalesce("b", F.lit(0.0)), 4).alias("benchmark")), [F.col("year")], s),
        "benchmark": obj(rel, s),
        "overfitting": obj(an.overfitting_summary(r).withColumnRenamed(s, "selected")),
        "logit_histogram": rows(an.logit_histogram(logits), [F.col("bin")]),
        "portfolio": rows(w.select("symbol", F.col("weight").cast("double").alias("weight")), [-F.col("weight"), F.col("symbol")]),
        "asset_classes": rows(tgt.composition(w.select(F.col("decision_session").alias("session"), "symbol", F.col("weight").cast("double").alias("weight")), classes).select("asset_class", F.round("weight", 6).alias("weight")), [-F.col("weight"), F.col("asset_class")]),
        "risk": rows(checks, [F.col("seq")]),
        "quality": obj(cal.completeness(bars, cal.observed(bars)).withColumnRenamed("symbol", s), s),
        "experiments": rows(ranked.select("run_id", "study", "robust_sharpe", "sharpe", "max_drawdown", "turnover", "status"), [-F.col("robust_sharpe"), F.col("run_id")]),
    }


def report_payload(spark, d):
    """One JSON document a series: what it did, how it compares, what the desk holds and how the checks and runs stand."""
    return report.assemble(*blocks(spark, d), "strategy")


Q["report_payload"] = report_payload
