"""Known answers on tiny frames."""

import datetime as dt
import math

import pytest

from strandline.functions import linear
from strandline.operators import analytics, calendars, features, modelling, orders, registry, replay, targets, validation
from strandline.sources import digests, ingest, panel


def returns(spark, values, name="s", start=dt.date(2024, 1, 1)):
    return spark.createDataFrame([(name, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "strategy string, session date, ret double")


def bars(spark, rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), c, c + 1.0, c - 1.0, c, 100.0, c, 5) for s, d, c in rows], "symbol string, session date, open double, high double, low double, close double, volume double, vwap double, trade_count long")


def test_drawdowns(spark):
    dd = analytics.drawdowns(returns(spark, [0.1, -0.5, 0.0]))
    assert [round(r.dd, 10) for r in dd.orderBy("session").collect()] == [0, -0.5, -0.5]
    assert analytics.drawdown_duration(analytics.drawdowns(returns(spark, [0.1, -0.5, 0.1, 0.1]))).first()[1] == 3
    assert analytics.time_to_recovery(analytics.drawdowns(returns(spark, [0.1, -0.5, 0.5, 0.5]))).first()[1] == 2
    assert analytics.time_to_recovery(analytics.drawdowns(returns(spark, [0.1, -0.5, 0.01, 0.01]))).first()[1] is None


def test_total_loss_keeps_growth_at_zero(spark):
    got = [r.equity for r in analytics.growth_curve(returns(spark, [0.1, -1.0, 0.5])).orderBy("session").collect()]
    assert got[0] == pytest.approx(1.1) and got[1:] == [0.0, 0.0]
    got = [r.equity for r in analytics.growth_curve(returns(spark, [-3.0, 0.5])).orderBy("session").collect()]
    assert got == pytest.approx([-2.0, -3.0])


def test_equity_returns_and_months(spark):
    e = spark.createDataFrame([("s", dt.date(2024, 1, 1), 110.0), ("s", dt.date(2024, 1, 2), 121.0)], "strategy string, session date, equity double")
    assert [r.ret for r in analytics.equity_returns(e, 100.0).orderBy("session").collect()] == pytest.approx([0.1, 0.1])
    m = spark.createDataFrame([("s", dt.date(2024, 1, 10), 0.1), ("s", dt.date(2024, 1, 20), 0.1), ("s", dt.date(2024, 2, 5), -0.5)], "strategy string, session date, ret double")
    assert [r.ret for r in analytics.compounded(m, "year", "month").orderBy("month").collect()] == pytest.approx([0.21, -0.5])


def test_summary_of_an_empty_frame_is_empty(spark):
    assert analytics.performance_summary(returns(spark, [])).count() == 0


def test_benchmark_and_attribution(spark):
    import numpy as np

    b = np.random.default_rng(1).normal(0, 0.01, 120)
    got = analytics.benchmark_stats(analytics.aligned(returns(spark, 2 * b), returns(spark, b, "b"))).first()
    assert got.beta == pytest.approx(2) and got.correlation == pytest.approx(1) and got.alpha_annualized == pytest.approx(0, abs=1e-8)
    c = np.random.default_rng(2).normal(0, 0.01, 120)
    df = spark.createDataFrame([("k", float(1.5 * x + 0.5 * y), float(x), float(y)) for x, y in zip(b, c)], "key string, y double, x1 double, x2 double")
    betas = {r.factor: r.beta for r in linear.attribution(df, "key", "y", ["x1", "x2"]).collect()}
    assert betas == pytest.approx({"x1": 1.5, "x2": 0.5})
    assert linear.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and linear.t_tail(0.0, 5) == 1.0


def test_pbo_of_a_dominant_trial_is_small(spark):
    import numpy as np

    rng, frames = np.random.default_rng(3), None
    for k in range(4):
        f = returns(spark, rng.normal(0.02 if k == 0 else 0.0, 0.01, 100), f"t{k}")
        frames = f if frames is None else frames.unionByName(f)
    rows = analytics.pbo_logits(frames).collect()
    assert len(rows) == 252 and all(r.winner == "t0" and r.logit > 0 for r in rows)


def test_quality_rules(spark):
    cal = bars(spark, [("A", "2024-01-01", 1.0), ("A", "2024-01-02", 1.0), ("A", "2024-01-03", 1.0)])
    b = bars(spark, [("A", "2024-01-01", 2.0), ("A", "2024-01-03", 3.0), ("X", "2024-01-03", 3.0), ("A", "2024-01-03", 3.0)])
    u = spark.createDataFrame([("v", "A"), ("v", "B")], "universe_version string, symbol string")
    codes = [r.code for r in validation.quality_report(b, u, calendars.observed(cal), "2024-01-03").collect()]
    assert codes == ["symbol_outside_universe", "missing_universe_symbol", "duplicate_bar", "incomplete_latest_session", "missing_session"]
    assert [r.code for r in validation.quality_report(b.limit(0), u, calendars.observed(cal), "2024-01-03").collect()] == ["empty_input"]


def test_features_begin_at_bar_127_and_do_not_leak(spark):
    rows = [("A", (dt.date(2020, 1, 1) + dt.timedelta(days=i)).isoformat(), 100 + math.sin(i) * 5 + i / 10) for i in range(180)]
    f = features.feature_rows(bars(spark, rows), "x").orderBy("decision_session").collect()
    assert [r.missing for r in f].index(False) == 126 and all(r.return_21 == 0.0 for r in f[:126])
    assert f[0].forward_return_21 is not None and f[-1].forward_return_21 is None
    assert features.leakage(bars(spark, rows), "2020-05-20").count() == 0
    with pytest.raises(ValueError):
        features.feature_rows(bars(spark, rows), "x", 5)


def test_running_ridge_equals_a_fit_on_the_rows(spark):
    import numpy as np

    rows = [(s, (dt.date(2019, 1, 1) + dt.timedelta(days=i)).isoformat(), 50 + 10 * k + 3 * math.sin(i / (3 + k)) + 0.01 * i) for k, s in enumerate("ABC") for i in range(260)]
    z = features.xs_zscore(features.feature_rows(bars(spark, rows), "x").where("not missing")).cache()
    c = modelling.ridge_coefficients(z, spark.createDataFrame([(10.0,)], "alpha double")).orderBy("decision_session").collect()[-1]
    start = {r.decision_session: r.embargo_start for r in modelling.decisions(z).collect()}[c.decision_session]
    t = [r for r in z.collect() if r.label_end_session and r.label_end_session < start]
    x, y = np.array([[r[n] for n in modelling.Z] for r in t]), np.array([r.forward_return_21 for r in t])
    xc = x - x.mean(0)
    beta = np.linalg.solve(xc.T @ xc + 10 * np.eye(6), xc.T @ (y - y.mean()))
    assert c.n == len(t) and c.beta == pytest.approx(beta.tolist(), abs=1e-9)


def test_targets_respect_their_limits(spark):
    s = spark.createDataFrame([(1.0, dt.date(2024, 1, 1), n, f, v) for n, f, v in [("AAPL", 0.05, 0.20), ("GOOG", 0.03, 0.22), ("MSFT", 0.04, 0.18), ("NVDA", 0.06, 0.30), ("TSLA", 0.02, 0.40)]], "alpha double, decision_session date, symbol string, forecast double, vol double")
    w = targets.quantised(targets.constrained(targets.desired(s))).collect()
    vol = {r.symbol: r.vol for r in s.collect()}
    assert max(float(r.weight) for r in w) <= 0.25 and sum(float(r.weight) for r in w) <= 0.95 and sum((float(r.weight) * vol[r.symbol]) ** 2 for r in w) <= 0.15**2 + 1e-9
    assert targets.cash(targets.quantised(targets.constrained(targets.desired(s.where("false")))), s).first().cash_weight == 1


def test_ledger(spark):
    f = spark.createDataFrame([("a", 1, "SPY", 100, 500.0)], "account string, seq int, symbol string, qty int, price double")
    r = replay.fill_ledger(f, "1000000", "5", ("seq",)).first()
    assert (float(r.cash), float(r.total_costs), r.position) == (949975.0, 25.0, 100)


def test_reconciliation_order_and_defaults(spark):
    cash = lambda x: spark.createDataFrame([("a", x)], "account string, cash int")
    pos = lambda rows: spark.createDataFrame(rows, "account string, symbol string, qty int")
    got = orders.reconciliation(orders.recon_cash(cash(100000), cash(99000)), orders.recon_positions(pos([]), pos([("a", "SPY", 5), ("a", "AAA", 1)]))).collect()
    assert [(r.kind, r.item, r.internal, r.broker) for r in got] == [("cash", "cash", "100000", "99000"), ("position", "AAA", "0", "1"), ("position", "SPY", "0", "5")]


def test_registry(spark):
    runs = spark.createDataFrame([("s", "r1", "k", 0.5, 1.0, -0.1, 0.1), ("s", "r2", "k", 1.5, 1.0, -0.1, 0.1), ("t", "r3", "k", 1.0, 1.0, -0.1, 0.1), ("t", "r4", "j", 1.0, 1.0, -0.1, 0.1)], "study string, run_id string, compatibility_key string, robust_sharpe double, sharpe double, max_drawdown double, turnover double").selectExpr("*", "false as git_dirty", "'ok' as tracking_status")
    ranked = registry.ranking(registry.objective_status(runs, -0.5, 1.0), "study").orderBy("rank").collect()
    assert [(r.run_id, r.rank) for r in ranked] == [("r2", 1), ("r1", 2)]
    df = spark.createDataFrame([({"api_key": "x", "note": "y", "auth_token": None},)], "m map<string,string>")
    assert registry.redact(df, "m").first().m == {"api_key": "[REDACTED]", "note": "y", "auth_token": "[REDACTED]"}


def test_json_and_snapshots(spark):
    bad = spark.createDataFrame([('{"bars": {"A": [{"t": "2024-01-02T05:00:00Z", "o": "1", "h": "2", "l": "1", "c": "x", "v": 1, "vw": "1", "n": 1}]}}',)], "payload string")
    assert ingest.bars_from_json(bad, "payload").first().reason == "bad_close"
    b = bars(spark, [("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0)])
    assert digests.publish_and_verify(b, "t").first().verified
    assert digests.digest(b).first() == digests.digest(b.orderBy(b.session.desc())).first() != digests.digest(b.limit(1)).first()
    back = ingest.reload(ingest.evidence(b, "bar", "2024-01-01 00:00:00", "session"), b.schema)
    assert sorted(back.collect()) == sorted(b.collect())


def test_last_completed_session(spark):
    cal = calendars.build(spark, "2024-01-01", "2024-02-29")
    t = spark.createDataFrame([(dt.datetime(2024, 2, 5, 21),), (dt.datetime(2024, 2, 5, 20, 59),), (dt.datetime(2023, 1, 1),)], "ts timestamp")
    got = [r.last_session for r in calendars.last_completed(t, cal, "ts").orderBy("ts").collect()]
    assert got == [None, dt.date(2024, 2, 2), dt.date(2024, 2, 5)]


def test_bars_follow_the_total_order(spark):
    x = spark.createDataFrame([("A", 1, 2, 10.0, 1.0), ("A", 1, 1, 12.0, 3.0), ("A", 1, 3, 11.0, 1.0)], "symbol string, session int, o int, price double, qty double")
    r = panel.bars_of(x, order=("o",)).first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.vwap) == (12.0, 12.0, 10.0, 11.0, 5.0, 11.4)


def test_every_decision_has_coefficients_forecasts_and_targets(spark, monkeypatch):
    from strandline.plans import model_queries

    rows = [(s, (dt.date(2019, 1, 1) + dt.timedelta(days=i)).isoformat(), 50 + 10 * k + 3 * math.sin(i / (3 + k)) + 0.01 * i) for k, s in enumerate("ABC") for i in range(200)]
    feats = features.feature_rows(bars(spark, rows), "x").cache()
    monkeypatch.setattr(model_queries, "rows", lambda *_: feats)
    z = feats.where("not missing")
    first = z.where("label_end_session is not null").agg({"label_end_session": "min"}).first()[0]
    days = {r.decision_session for r in modelling.decisions(z).where("embargo_start is not null").collect() if r.embargo_start > first}
    assert len(days) > 21
    c = model_queries.ridge_coefficients(spark, None).collect()
    assert {(r.decision_session, r.alpha) for r in c} == {(d, a) for d in days for a in (1.0, 10.0, 100.0)} and len(c) == 3 * len(days)
    f = model_queries.forecasts(spark, None).collect()
    assert {r.decision_session for r in f} == days and len(f) == 9 * len(days)
    good = {(r.alpha, r.decision_session) for r in f if r.forecast > 0}
    got = {(r.alpha, r.decision_session) for r in model_queries.target_weights(spark, None).collect()}
    assert got == good


def test_training_membership_states_every_split(spark):
    rows = [(s, (dt.date(2019, 1, 1) + dt.timedelta(days=i)).isoformat(), 50 + 10 * k + 3 * math.sin(i / (3 + k)) + 0.01 * i) for k, s in enumerate("ABC") for i in range(230) if (i + k) % 11]
    f = features.feature_rows(bars(spark, rows), "x").cache()
    want = {}
    for d in modelling.decisions(f).collect():
        want[d.decision_session] = {(r.symbol, r.decision_session) for r in f.collect() if d.embargo_start and not r.missing and r.forward_return_21 is not None and r.label_end_session and r.label_end_session < d.embargo_start}
    got = modelling.training_membership(f).collect()
    assert {d: {(r.symbol, r.training_session) for r in got if r.first_decision and r.first_decision <= d} for d in want} == want
    assert len({len(x) for x in want.values()}) > 20 and len(got) == modelling.usable(f).count()


def test_held_weights_follow_the_retrain_cadence(spark, monkeypatch):
    from strandline.plans import model_queries

    days = [dt.date(2019, 1, 1) + dt.timedelta(days=i) for i in range(700)]
    signals = spark.createDataFrame([(d, s, 0.01 + (i % 50) * 0.001 * (1 + k), 0.2) for i, d in enumerate(days) for k, s in enumerate("ABC")], "decision_session date, symbol string, forecast double, vol double")
    monkeypatch.setattr(model_queries, "_signals", lambda *_: signals)
    monkeypatch.setattr(model_queries, "rect", lambda *_: signals.selectExpr("decision_session as session"))
    got = {r.session: r.weights for r in model_queries.held_weights(spark, None).collect()}
    assert sorted(got) == days[600:]
    changes = [i for i in range(601, 700) if got[days[i]] != got[days[i - 1]]]
    assert changes == [621, 642, 663, 684]


def test_every_broker_state(spark):
    want = {"new": "new", "ACCEPTED": "new", "stopped": "new", "Filled": "filled", "calculated": "filled", "replaced": "rejected", "done_for_day": "rejected", "SUSPENDED": "rejected", "pending_cancel": "new", "what": "new", None: "new"}
    import json

    raw = spark.createDataFrame([(json.dumps({"id": str(i), "status": s, "qty": "3.0"}),) for i, s in enumerate(want)], "payload string")
    assert [r.state for r in ingest.orders_from_json(raw, "payload").orderBy("order_id").collect()] == [s for _, s in sorted((str(i), s) for i, s in enumerate(want.values()))]
    assert len(ingest.STATES) == 17


def test_redaction_at_any_depth(spark):
    import json

    deep = {"dsn": 1, "context": {"auth_token": "t", "list": [{"ACCESS_KEY": [1]}, "x", 2.5]}, "note": "é"}
    df = spark.createDataFrame([(json.dumps(deep),), (None,), ("no json {",)], "payload string")
    got = [r.payload for r in registry.redact_json(df, "payload").collect()]
    assert json.loads(got[0]) == {"dsn": "[REDACTED]", "context": {"auth_token": "[REDACTED]", "list": [{"ACCESS_KEY": "[REDACTED]"}, "x", 2.5]}, "note": "é"} and got[1:] == [None, "[REDACTED]"]
    typed = spark.createDataFrame([((("p", [{"my_dsn": "d", "k": "v"}], 1.0), "n"),), (None,)], "r struct<a: struct<password: string, maps: array<map<string,string>>, token: double>, b: string>")
    rows = [r.r for r in registry.redact(typed, "r").collect()]
    assert rows[0].asDict(True) == {"a": {"password": "[REDACTED]", "maps": [{"my_dsn": "[REDACTED]", "k": "v"}], "token": None}, "b": "n"} and rows[1] is None


def test_few_rows_have_historical_cornish_fisher(spark):
    r = returns(spark, [-0.05, 0.01, 0.02])
    assert analytics.cornish_fisher(r).first().cornish_fisher_var == pytest.approx(0.044)
    assert analytics.performance_summary(r).first().cornish_fisher_var_95 == pytest.approx(0.044)
    assert analytics.cornish_fisher(returns(spark, [0.01] * 5)).first().cornish_fisher_var == 0


def test_canonical_numbers(spark):
    from pyspark.sql import functions as F

    want = {"1.50": "1.5", "-0.0": "0", "1E-11": "1e-11", "2.5e-7": "2.5e-7", "0.000001": "0.000001", "123400": "123400", "1e21": "1e+21", "12345678901234567890": "12345678901234567000", "-0.25": "-0.25", "100": "100"}
    df = spark.createDataFrame([(float(x), y) for x, y in want.items()], "x double, y string")
    assert [(r.y, r.z) for r in df.select("y", registry.canonical_number(F.col("x")).alias("z")).collect() if r.y != r.z] == []
    d = spark.sql("select cast(1.500000000000000000001 as decimal(38,21)) as x")
    assert d.select(registry.canonical_number(F.col("x"))).first()[0] == "1.500000000000000000001"


def test_gates(spark):
    b = bars(spark, [("A", "2024-01-02", 1.0), ("B", "2024-01-02", 1.0), ("A", "2024-01-03", 1.0), ("B", "2024-01-03", 1.0)])
    u, cal = b.select("symbol").distinct(), calendars.observed(b)
    from pyspark.sql import functions as F

    in_order = b.withColumn("no", F.datediff("session", F.lit("2024-01-01")) * 10 + F.ascii("symbol"))
    codes = lambda x: [r.code for r in validation.quality_report(x, u, cal, "2024-01-03", "no").collect()]
    assert codes(in_order) == ["ok"] and codes(in_order.withColumn("no", -F.col("no"))) == ["unsorted_bars"]
    issues = validation.quality_report(in_order.withColumn("no", -F.col("no")), u, cal, "2024-01-03", "no")
    with pytest.raises(ValueError):
        digests.publish_and_verify(b, "t", issues)
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "ret double")
    with pytest.raises(Exception, match="not finite"):
        modelling.finite_series(nan, "ret").collect()
    assert modelling.finite_series(nan.where("not isnan(ret)"), "ret").count() == 1


def test_missing_sessions_and_completeness(spark):
    b = bars(spark, [("A", "2024-01-02", 1.0), ("A", "2024-01-08", 1.0), ("B", "2024-01-02", 1.0), ("B", "2024-01-03", 1.0), ("B", "2024-01-04", 1.0), ("B", "2024-01-08", 1.0)])
    got = validation.missing_sessions(b, calendars.observed(b)).collect()
    assert [(r.symbol, r.missing, str(r.first_gap)) for r in got] == [("A", 2, "2024-01-03")]
    assert {(r.symbol, r.present, r.expected, r.excluded) for r in calendars.completeness(b, calendars.observed(b)).collect()} == {("A", 2, 4, 2), ("B", 4, 4, 0)}
