"""Two-level scans, halo blocks, exact quantiles, digest trees, the normal distribution and ragged fits against plain versions."""

import datetime as dt
import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import blocks, normal, quantiles
from strandline.operators import analytics, features, modelling
from strandline.sources import digests, ingest

DAY = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """A dense, a sparse (with a null key) and a short series, some values null."""
    rng = random.Random(1)
    rows = [(k, DAY + dt.timedelta(days=i * step), rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)])) for k, step, n in (("a", 1, 3000), (None, 40, 200), ("c", 3, 10)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, s date, v double").repartition(5).cache()


def same(got, want, *columns):
    a, b = (sorted(map(tuple, x.select("k", "s", *columns).collect()), key=str) for x in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("before", [False, True])
def test_running_figures_equal_one_window(series, descending, before):
    w = Window.partitionBy("k").orderBy(F.desc("s") if descending else "s").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    got = blocks.running(series, ["k"], "s", {"a": (F.col("v"), "sum"), "b": (F.col("v"), "max"), "c": (F.col("v"), "min"), "d": (F.col("v"), "last")}, descending=descending, before=before, width=100)
    want = series.withColumns({"a": F.sum("v").over(w), "b": F.max("v").over(w), "c": F.min("v").over(w), "d": F.last("v", ignorenulls=True).over(w)})
    same(got, want, "a", "b", "c", "d")


def test_numbers_and_previous_rows(series):
    w = Window.partitionBy("k").orderBy("s")
    got = blocks.previous(blocks.numbered(series, ["k"], "s", "no", width=50), ["k"], "s", "v", "before", F.lit(-9.0), width=50)
    same(got, series.withColumns({"no": F.row_number().over(w) - 1, "before": F.lag("v", 1, -9.0).over(w)}), "no", "before")


def test_windows_in_blocks_with_halos(series):
    def columns(w):
        return [{"l": F.lag("v", 126).over(w()), "m": F.avg("v").over(w(99)), "f": F.lead("s", 21).over(w())}]

    w = Window.partitionBy("k").orderBy("s")
    want = series.withColumns({"l": F.lag("v", 126).over(w), "m": F.avg("v").over(w.rowsBetween(-99, 0)), "f": F.lead("s", 21).over(w), "place": F.row_number().over(w) - 1})
    same(blocks.windowed(series, ["k"], "s", columns, 126, 21, size=150, width=64), want, "l", "m", "f", "place")
    with pytest.raises(ValueError):
        blocks.haloed(series, ["k"], "s", 300, size=150)
    with pytest.raises(TypeError):
        blocks.numbered(series, [], "v", "no")


def test_no_key_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1, 1), (DAY, 1, 5), (DAY, 0, 7), (DAY + dt.timedelta(days=3000), 0, 2)], "at date, kind int, n long")
    got = {(r.at, r.kind): r.t for r in blocks.running(df, [], "at", {"t": (F.col("n"), "sum")}, then=("kind",)).collect()}
    assert got == {(None, 1): 1, (DAY, 0): 8, (DAY, 1): 13, (DAY + dt.timedelta(days=3000), 0): 15}
    empty = df.where("false")
    assert blocks.running(empty, [], "at", {"t": (F.col("n"), "sum")}).count() == blocks.haloed(empty, ["kind"], "at", 3).count() == 0


def test_a_long_series_is_many_tasks_work(spark):
    """Of 40,000 rows of one series no window sees more than a range or a block with its halo."""
    df = spark.range(40_000).select(F.lit("x").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("s"), F.col("id").cast("double").alias("v"))
    x = blocks.haloed(df, ["k"], "s", 126, 21)
    assert x.groupBy("k", "__block").count().agg(F.max("count")).first()[0] <= blocks.BLOCK + 126 + 21
    got = blocks.running(df, ["k"], "s", {"t": (F.col("v"), "sum")})
    assert got.agg(F.max("t")).first()[0] == 40_000 * 39_999 / 2
    assert df.groupBy("k", blocks._range(df, "s", blocks.WIDTH)).count().agg(F.max("count")).first()[0] <= blocks.WIDTH


@pytest.mark.parametrize("bits", [16, 8])
def test_quantiles_equal_percentile(spark, monkeypatch, bits):
    """In one round (all series are small against its prefixes) and in several."""
    monkeypatch.setattr(quantiles, "BITS", bits)
    rng = random.Random(3)
    odd = [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf"), 1.5, 1.5, 1.5, None]
    rows = [(k, v) for k, n in (("a", 500), (None, 40), ("b", 2)) for v in [rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(n)] + odd * (n > 2)]
    df = spark.createDataFrame([*rows, ("empty", None), ("one", -2.5)], "k string, v double").repartition(4)
    shares = {"a": 0.05, "b": 0.01, "m": 0.5, "lo": 0.0, "hi": 1.0, "t": 1 / 3}
    got = quantiles.quantiles(df, "k", "v", shares).orderBy("k").collect()
    assert str(got) == str(df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()]).orderBy("k").collect())
    assert quantiles.quantiles(df.where("false"), "k", "v", shares).count() == 0


def test_order_statistics_at_any_places(spark):
    df = spark.range(1000).select(F.lit("s").alias("k"), (F.col("id") % 37 - 18).cast("double").alias("v"))
    want = spark.createDataFrame([("s", p) for p in (0, 1, 500, 999, 1000)] + [("none", 0)], "k string, place long")
    values = sorted(i % 37 - 18 for i in range(1000))
    assert {r.place: r.v for r in quantiles.order_statistics(df, "k", "v", want).collect()} == {p: float(values[p]) for p in (0, 1, 500, 999)}


def test_keys_sort_as_doubles_do(spark):
    values = [float("-inf"), -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.sortable(F.col("v")).alias("x"))
    rows = df.orderBy("x").collect()
    assert [r.v for r in rows] == values
    assert [r.b for r in df.select(quantiles.double_of(F.col("x")).alias("b")).collect()] == [r.v for r in df.collect()]


def test_tail_risk_of_few_and_no_returns(spark):
    rows = [("one", DAY, -0.1), ("two", DAY, -0.2), ("two", DAY + dt.timedelta(days=1), 0.1)]
    got = {r.strategy: r for r in analytics.var_cvar(spark.createDataFrame(rows, "strategy string, session date, ret double"), 0.95).collect()}
    assert got["one"].var == got["one"].cvar == 0.1
    assert math.isclose(got["two"].var, 0.185) and got["two"].cvar == 0.2
    assert analytics.var_cvar(spark.createDataFrame([], "strategy string, session date, ret double"), 0.95).count() == 0


def test_normal_distribution_to_double_precision(spark):
    xs = [i / 40 for i in range(-340, 341)] + [1e-12, -1e-12, 0.749999999, 0.75, 4.999999999, 5.0, 26.0, 40.0, -40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.erfc(F.col("x")).alias("e"), normal.cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert math.isclose(r.e, math.erfc(r.x), rel_tol=2e-13, abs_tol=1e-300), r
        assert abs(r.p - statistics.NormalDist().cdf(r.x)) < 1e-15
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(normal.erfc(F.col("x")).alias("e")).collect()
    assert odd[0].e is None and math.isnan(odd[1].e) and odd[2].e == 0.0 and odd[3].e == 2.0


def plain_root(rows, depth):
    """rows: canonical texts."""
    counts = {}
    for t in rows:
        h = hashlib.sha256(t.encode()).hexdigest()
        counts[h] = counts.get(h, 0) + 1
    leaves = {}
    for h in sorted(counts):
        leaves.setdefault(h[:depth], []).append(f"{h}*{counts[h]}")
    level = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in leaves.items()}
    for k in range(depth - 1, -1, -1):
        up = {}
        for node in sorted(level):
            up.setdefault(node[:k], []).append(f"{node[k]}={level[node]}")
        level = {n: hashlib.sha256(",".join(v).encode()).hexdigest() for n, v in up.items()} or {"": hashlib.sha256(b"").hexdigest()}
    return level[""]


def test_digest_tree_equals_a_plain_one_and_names_the_changed_leaf(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("t"), F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("x"))
    df = df.unionByName(df.where("id < 3"))  # copies
    text = lambda i: f"{len(str(i))}:{i}|1:{i % 7}|" + (f"{len(str(i / 4))}:{i / 4}" if i % 5 else "-")
    rows = [text(i) for i in [*range(500), 0, 1, 2]]
    got = digests.digest(df, 2).first()
    assert (got.rows, got.sha256) == (503, plain_root(rows, 2))
    assert digests.digest(df.repartition(7).select("x", "t", "id"), 2).first() == got
    changed = df.withColumn("t", F.when(F.col("id") == 77, "other").otherwise(F.col("t")))
    old = hashlib.sha256(text(77).encode()).hexdigest()[:2]
    new = hashlib.sha256(text(77).replace("|1:0|", "|5:other|").encode()).hexdigest()[:2]
    bad = digests.differences(digests.tree(df, 2), digests.tree(changed, 2)).where("level = 2")
    assert {r.node for r in bad.collect()} == {old, new}
    found = digests.changed_rows(changed, bad, 2).collect()
    assert any(r.id == 77 for r in found) and len(found) < 40
    v = digests.verify(changed, ingest.written(digests.tree(df, 2), "m"), 2).first()
    assert not v.verified and v.bad_leaves == len({old, new}) and digests.verify(df, digests.tree(df, 2), 2).first().verified
    # A lost or a doubled row is told, too.
    assert digests.differences(digests.tree(df, 1), digests.tree(df.where("id <> 9"), 1)).count() == 2
    assert digests.differences(digests.tree(df, 1), digests.tree(df.unionByName(df.where("id = 9")), 1)).count() == 2


def test_digest_of_nothing_depths_and_nested_values(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert digests.digest(empty).first() == (0, 1, hashlib.sha256(b"").hexdigest())
    assert [digests.depth_for(n) for n in (0, 4096 * 16, 4096 * 16 + 1, 10**12)] == [1, 1, 2, 7]
    one = spark.sql("select map('b', 1, 'a', 2) as m, struct(array(map(1, 'x')) as l) as s, cast('q' as binary) as r")
    two = spark.sql("select map('a', 2, 'b', 1) as m, struct(array(map(1, 'x')) as l) as s, cast('q' as binary) as r")
    assert digests.digest(one).first() == digests.digest(two).first()
    # Borders of values are part of the text.
    a, b = (spark.createDataFrame([x], "a string, b string") for x in (("1|2", ""), ("1", "2|")))
    assert digests.digest(a).first() != digests.digest(b).first()
    n, m = (spark.createDataFrame([x], "a string, b string") for x in ((None, "-"), ("-", None)))
    assert digests.digest(n).first() != digests.digest(m).first()


def test_manifest_rules(spark):
    good = {"dataset": "daily_bars", "snapshot_id": "a.b:2024-01-02", "source": "s", "schema_version": 1, "row_count": 0, "content_sha256": "0" * 64, "data_files": ["a/b.parquet", "./c", "a//b"]}
    bad = [("dataset", "Bars"), ("dataset", "1a"), ("dataset", "a\n"), ("snapshot_id", ".."), ("snapshot_id", "a/b"), ("snapshot_id", ""), ("source", ""), ("schema_version", 0), ("row_count", -1), ("content_sha256", "G" * 64), ("content_sha256", "0" * 63), ("row_count", None)]
    bad += [("data_files", [p]) for p in ("", ".", "/a", "a/../b", "..", "C:/x", "C:x", "\\\\host\\x", "a\\..\\b", "//host/x", None)]
    rows = [good, *[good | {k: v} for k, v in bad]]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "dataset string, snapshot_id string, source string, schema_version int, row_count long, content_sha256 string, data_files array<string>")
    got = [r.v for r in df.coalesce(1).select(digests.valid_manifest().alias("v")).collect()]
    assert got == [True] + [False] * len(bad)


def ragged_rows(rng, symbols=5, sessions=120):
    """Feature rows of a panel with gaps: labels of one session end at different times."""
    out = []
    for k in range(symbols):
        own = [i for i in range(sessions) if rng.random() < 0.8]
        for at, i in enumerate(own):
            end = own[at + 8] if at + 8 < len(own) else None
            x = [rng.gauss(0, 1) * (1e6 if j == 5 else 1) if j != 2 or i % 3 else 0.25 for j in range(6)]
            out.append((f"s{k}", DAY + dt.timedelta(days=i), *x, rng.gauss(0, 0.1) if end is not None else None, DAY + dt.timedelta(days=end) if end is not None else None, at < 4, "x"))
    return out


def test_fits_of_a_ragged_panel_equal_fits_by_rows(spark):
    rows = ragged_rows(random.Random(6))
    names = ["symbol", "decision_session", *features.FEATURES, "forward_return_21", "label_end_session", "missing", "snapshot_id"]
    df = spark.createDataFrame(rows, "symbol string, decision_session date, " + ", ".join(f"{c} double" for c in features.FEATURES) + ", forward_return_21 double, label_end_session date, missing boolean, snapshot_id string").repartition(4)
    alphas = spark.createDataFrame([(1.0,), (10.0,)], "alpha double")
    got = {(r.decision_session, r.alpha): r for r in modelling.ridge_coefficients(df, alphas).collect()}
    sessions = sorted({r[1] for r in rows})
    straddled = 0
    for i, day in enumerate(sessions):
        cut = sessions[i - 20] if i >= 20 else None
        seen = [r for r in rows if cut and not r[10] and r[8] is not None and r[9] < cut]
        if not seen:
            assert (day, 1.0) not in got
            continue
        z, y = [], []
        for s in sorted({r[1] for r in seen}):
            part = np.array([r[2:8] for r in seen if r[1] == s])
            straddled += len(part) < sum(r[1] == s and not r[10] and r[8] is not None for r in rows)
            sd = part.std(axis=0, ddof=1) if len(part) > 1 else np.zeros(6)
            z.append(np.where(sd > 1e-12, (part - part.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), 0.0))
            y += [r[8] for r in seen if r[1] == s]
        z, y = np.concatenate(z), np.array(y)
        for alpha in (1.0, 10.0):
            c = z - z.mean(axis=0)
            beta = np.linalg.solve(c.T @ c + alpha * np.eye(6), c.T @ (y - y.mean()))
            r = got[day, alpha]
            assert r.n == len(y)
            assert np.allclose(r.beta, beta, rtol=1e-7, atol=1e-9) and math.isclose(r.intercept, y.mean() - z.mean(axis=0) @ beta, rel_tol=1e-7, abs_tol=1e-9)
    assert straddled > 50 and names


def test_new_keys_keep_the_least_row(spark):
    new = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "y"), ("old", 0, "q")], "id string, n int, t string").repartition(3)
    stored = spark.createDataFrame([("old",)], "id string")
    assert [tuple(r) for r in ingest.to_insert(new, stored, "id").collect()] == [("k", 1, "y")]


def test_canonical_json_equals_the_plain_form(spark):
    """Structs, maps and arrays of any depth against a plain encoder's text."""
    import decimal
    import json

    from strandline.operators import registry

    floats = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 9.9e-5, 123456789.125, 1e15, 1e16, 1.7e16, -2.5e-300, 3e300, 1e-310, 12345678901234567890.0]
    decimals = ["0", "-0.00", "1.50", "-12.000", "1000000", "0.000001", "0.00000012", "123456789012345678.9"]
    texts = ["", "plain", 'q"\\/', "tab\tnl\ncr\rbs\bff\f", "\x01\x1f\x7f", "é ü 日本", "\U0001f600x", " "]
    rows = [(f, [f, None], {texts[i % 8]: f, "b": 1.0, "a": None}, decimal.Decimal(decimals[i % 8]), texts[i % 8], i, i % 2 == 0, ([{"z": [texts[i % 8]]}],)) for i, f in enumerate(floats)]
    rows.append((None,) * 8)
    schema = "f double, l array<double>, m map<string,double>, d decimal(38,18), t string, i long, b boolean, n struct<deep array<map<string,array<string>>>>"
    df = spark.createDataFrame(rows, schema)
    got = df.coalesce(1).select(registry.canonical_json(F.struct("*"), df.schema).alias("j")).collect()

    def number(d):
        d = d.normalize()
        if not d:
            return "0"
        return format(d, "f") if -6 <= d.adjusted() <= 20 else f"{d:e}".replace("E", "e")

    def plain(x):
        if isinstance(x, decimal.Decimal):
            return number(x)
        if isinstance(x, float):
            return 0.0 if x == 0 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    for r, row in zip(got, rows):
        value = dict(zip("flmdtibn", row))
        if row[7] is not None:
            value["n"] = {"deep": row[7][0]}
        assert r.j == json.dumps({k: plain(v) for k, v in value.items()}, sort_keys=True, separators=(",", ":")), (r.j, value)
    with pytest.raises(Exception, match="non-finite"):
        spark.createDataFrame([(float("nan"),)], "f double").select(registry.canonical_json(F.col("f"), df.schema["f"].dataType)).collect()


def test_preview_rows_and_fill_order(spark):
    from strandline.operators import orders

    intents = spark.createDataFrame([("a", "X", "buy", "id1"), ("c", "Y", "sell", "id2")], "account string, symbol string, side string, client_order_id string")
    checks = spark.createDataFrame([("a", 1, "r1", "pass", None), ("a", 2, "r2", "pass", None), ("b", 1, "r1", "block", "why")], "proposal_id string, seq int, code string, status string, detail string")
    gaps = spark.createDataFrame([("d", 1, "cash", "cash", "1", "2")], "account string, seq int, kind string, item string, internal string, broker string")
    got = sorted(map(tuple, orders.preview(intents, checks, gaps).select("account", "part", "item", "status", "blocked").collect()))
    assert got == [("a", "intent", "X", "buy", False), ("a", "rule", "r1", "pass", False), ("a", "rule", "r2", "pass", False), ("c", "intent", "Y", "sell", True), ("d", "difference", "cash cash", "block", True)]
    fills = spark.createDataFrame([(DAY + dt.timedelta(days=i * 700 % 2000), i) for i in range(9)], "at date, k int").repartition(3)
    seen = [(r["at"], r.k) for r in orders.recent_fills(fills, "at", "k").orderBy("seq").collect()]
    assert seen == sorted(seen) and len(seen) == 9


def test_returns_that_are_not_finite_stop_analytics(spark):
    df = modelling.finite_series(spark.createDataFrame([("s", DAY, 0.1), ("s", DAY + dt.timedelta(days=1), float("nan"))], "strategy string, session date, ret double"), "ret")
    with pytest.raises(Exception, match="not finite"):
        analytics.var_cvar(df, 0.95).collect()


def test_logit_bins_keep_empty_ones_and_widen_a_constant(spark):
    x = spark.createDataFrame([(v,) for v in (-2.0, -2.0, 0.0, 2.0)], "logit double")
    rows = analytics.logit_histogram(x).orderBy("bin").collect()
    counts, edges = np.histogram([-2.0, -2.0, 0.0, 2.0], bins=21)
    assert [r.n for r in rows] == counts.tolist() and [r.centre for r in rows] == [round((a + b) / 2, 4) for a, b in zip(edges, edges[1:])]
    assert sum(r.n for r in analytics.logit_histogram(x.where("logit = 0")).collect()) == 1


def test_report_documents_hold_every_block_in_order(spark):
    import json

    from strandline.operators import report

    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    one = spark.createDataFrame([("a", 1.5, None), ("c", 2.0, "x")], "k string, v double, t string")
    many = spark.createDataFrame([("b", 2, "q"), ("b", 1, "r"), ("a", 3, "s")], "k string, n int, t string")
    everywhere = spark.createDataFrame([(7,)], "n int")
    got = report.assemble(keys, {"one": report.as_object(one, "k"), "many": report.as_list(many, [F.col("n")], "k"), "all": report.as_list(everywhere, [F.col("n")]), "none": report.as_object(everywhere.where("false"))}, "k").collect()
    docs = {r.k: r.payload for r in got}
    assert json.loads(docs["a"]) == {"one": {"v": 1.5, "t": None}, "many": [{"n": 3, "t": "s"}], "all": [{"n": 7}], "none": None}
    assert docs["b"] == '{"one":null,"many":[{"n":1,"t":"r"},{"n":2,"t":"q"}],"all":[{"n":7}],"none":null}' and len(docs) == 2


def test_artifacts_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    from strandline.operators import registry

    monkeypatch.setattr(registry, "PIECE", 7)
    files = {"report.md": b"# x\n", "a b/spec.json": b"{}", "deep/er/x.bin": bytes(range(256)) * 10, "empty.csv": b""}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.relative_path: (r.sha256, r.size, r.media_type) for r in registry.artifact_inventory(spark, f"file://{tmp_path}").collect()}
    kinds = {"report.md": "text/markdown", "a b/spec.json": "application/json", "deep/er/x.bin": "application/octet-stream", "empty.csv": "text/csv"}
    assert got == {n: (hashlib.sha256(c).hexdigest(), len(c), kinds[n]) for n, c in files.items() if c}


def test_payload_fields_by_path(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, 2.5]}, "t": "x"}'), (2, '{"a": 7}'), (3, "not json"), (4, None), (5, "[1]")], "id int, p string")
    got = ingest.fields(rows, "p", {"b": ("$.a.b[1]", "double"), "t": ("$.t", "string"), "a": ("$.a", "int")}, "id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2.5, "x", None), (2, None, None, 7), (3, None, None, None), (4, None, None, None), (5, None, None, None)]
    keys = sorted(map(tuple, ingest.keys_of(rows, "p").collect()))
    assert [(k, n) for k, _, n in keys] == [("a", 1), ("a", 1), ("t", 1)]
