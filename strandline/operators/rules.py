"""Pre-trade rules over a table of proposals: every rule gives one row for each proposal, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMITS = {"position": 0.25, "cash": 0.05, "order": 0.10, "rebalance": 0.50, "minimum": 500.0}


def aggregates(proposals: DataFrame, weights: DataFrame, orders: DataFrame) -> DataFrame:
    """Headers with sums of their children: one aggregate for each child table, joined on the proposal."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    w = weights.groupBy("proposal_id").agg(bad("weight").alias("bad_w"), F.max(F.abs("weight")).alias("max_w"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
    o = orders.groupBy("proposal_id").agg(bad("notional").alias("bad_n"), F.max(F.abs("notional")).alias("max_n"), F.sum(F.abs("notional")).alias("sum_n"), F.min(F.abs("notional")).alias("min_n"), F.count("intent_id").alias("ids"), F.count_distinct("intent_id").alias("kinds"))
    x = proposals.join(w, "proposal_id", "left").join(o, "proposal_id", "left")
    return x.fillna(0, ["bad_w", "max_w", "gross", "net", "bad_n", "max_n", "sum_n", "ids", "kinds"])


def _verdicts(limits: dict[str, float]) -> Column:
    """(seq, code, status, detail) of the seventeen rules over a row of ``aggregates``, in their order; detail says what blocks, to six places, and is null for a pass. A rule that nulls leave open blocks."""
    c, tiny = F.col, 1e-9
    shown = lambda e: e.cast("decimal(38,6)").cast("string")
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    text = lambda name: c(name).cast("string")
    order, rebalance = limits["order"] * c("equity"), limits["rebalance"] * c("equity")
    rules: list[tuple[str, Column, Column]] = [
        ("snapshot_health", ~c("snapshot_blocked"), said("snapshot is blocked")),
        ("snapshot_freshness", c("snapshot_last") == c("expected_last"), said(text("snapshot_last"), " is not ", text("expected_last"))),
        ("decision_session_freshness", c("decision_session") == c("expected_decision"), said(text("decision_session"), " is not ", text("expected_decision"))),
        ("model_version", c("model_version") == c("expected_model"), said(c("model_version"), " is not ", c("expected_model"))),
        ("feature_version", c("feature_version") == c("expected_feature"), said(c("feature_version"), " is not ", c("expected_feature"))),
        ("finite_values", (c("bad_w") + c("bad_n") == 0) & ~F.isnan("equity") & ~F.isnan("cash_weight"), said((c("bad_w") + c("bad_n")).cast("string"), " weights and notionals are not finite")),
        ("position_limit", (c("bad_w") == 0) & (c("max_w") <= limits["position"] + tiny), said(shown(c("max_w")), f" > {limits['position']}")),
        ("gross_exposure", c("gross") <= 1 + tiny, said(shown(c("gross")), " > 1")),
        ("net_exposure", c("net").between(-tiny, 1 + tiny), said(shown(c("net")), " is not between 0 and 1")),
        ("cash_reserve", c("cash_weight") >= limits["cash"] - tiny, said(shown(c("cash_weight")), f" < {limits['cash']}")),
        ("per_order_notional", c("max_n") <= order + tiny, said(shown(c("max_n")), " > ", shown(order))),
        ("total_rebalance_notional", c("sum_n") <= rebalance + tiny, said(shown(c("sum_n")), " > ", shown(rebalance))),
        ("minimum_order_notional", c("min_n").isNull() | (c("min_n") >= limits["minimum"]), said(shown(c("min_n")), f" < {limits['minimum']}")),
        ("duplicate_intent", c("ids") == c("kinds"), said((c("ids") - c("kinds")).cast("string"), " repeated")),
        ("broker_account_status", ~(c("account_blocked") | c("trading_blocked")), F.concat_ws(", ", F.when(c("account_blocked"), "account blocked"), F.when(c("trading_blocked"), "trading blocked"))),
        ("reconciliation", ~c("reconciliation_blocked"), said("reconciliation is blocked")),
        ("live_trading_disabled", ~c("live_enabled"), said("live trading is enabled")),
    ]

    def row(i: int, code: str, ok: Column, why: Column) -> Column:
        fine = F.coalesce(ok, F.lit(False))
        return F.struct(F.lit(i).alias("seq"), F.lit(code).alias("code"), F.when(fine, "pass").otherwise("block").alias("status"), F.when(~fine, F.coalesce(why, F.lit("a value is missing"))).alias("detail"))

    return F.array(*[row(i, *rule) for i, rule in enumerate(rules, 1)])


def checks(x: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(proposal_id, seq, code, status, detail): a row for each rule and row of ``aggregates``."""
    return x.select("proposal_id", F.inline(_verdicts(limits)))


def gate(x: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(proposal_id, by_rules, blocking_rules) of each row of ``aggregates``: whether a rule blocks it, and the codes of those that do, in order. Nothing is exploded or shuffled."""
    codes = F.transform(F.filter(_verdicts(limits), lambda r: r["status"] == "block"), lambda r: r["code"])
    return x.select("proposal_id", codes.alias("codes")).select("proposal_id", (F.size("codes") > 0).alias("by_rules"), F.array_join("codes", ",").alias("blocking_rules"))


def summary(rows: DataFrame) -> DataFrame:
    x = rows.groupBy("proposal_id").pivot("status", ["pass", "block"]).count().fillna(0)
    return x.select("proposal_id", F.col("pass").alias("passed"), F.col("block").alias("blocks"), (F.col("block") > 0).alias("blocked"))
