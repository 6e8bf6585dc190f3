"""Exact cash in reconciliation, previews from one table of holdings, and quality learnt from every labelled document."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import bpe, quality, queries
from strandline.plans import desk_queries as dq
from strandline.plans import report_queries


def desk(spark, path, orders, lines=()):
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(list(lines), "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#12", 100.0), (2, "Brand#13", 900.0)], "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(k, 50.0 * k) for k in range(1, 6)], "c_custkey long, c_acctbal double").write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_cash_is_an_exact_sum(spark, tmp_path):
    # Ten times 0.1 is 1, but as doubles it is a little less, and its floor 0: account 1 would show no cash at all.
    path = desk(spark, tmp_path, [(i, 1, "P", 0.1) for i in range(10)] + [(20, 2, "F", 3.5), (21, 2, "F", None)])
    got = {(r.account, r.internal, r.broker) for r in dq.reconciliation(spark, path).where("kind = 'cash'").collect()}
    assert got == {(1, "1", "0"), (2, "0", "3")}


def test_preview_reads_one_table_of_positions(spark, tmp_path, monkeypatch):
    """Both sides of a position in one row; null keys equal none; the gate of a row is that of its seventeen rules."""
    lines = [(0, 1, 5.0), (1, 1, 2.0), (0, 2, 4.0), (1, 9, 7.0), (2, 9, 3.0)]
    path = desk(spark, tmp_path, [(0, 1, "O", 10.0), (1, 1, "F", 20.0), (2, 3, "P", 30.0), (None, 4, "O", 1.0)], lines)
    spark.createDataFrame([(9, None, 1.0)], "p_partkey long, p_brand string, p_retailprice double").write.mode("append").parquet(f"{path}/part.parquet")
    names, write = [], dq.ingest.written
    monkeypatch.setattr(dq.ingest, "written", lambda df, name: names.append(name) or write(df, name))
    rows = dq.execution_preview(spark, path).collect()
    assert names == ["positions"]
    assert {(r.account, r.symbol, r.side, r.qty, r.differences) for r in rows} == {(1, "Brand#13", "buy", 4, 5)}
    assert {(r.account, r.symbol, r.delta) for r in dq.position_deltas(spark, path).collect()} == {(1, "Brand#12", 3), (1, "Brand#13", 4), (3, None, 3)}
    gaps = {(r.account, r.item, r.internal, r.broker) for r in dq.recon_positions(spark, path).collect()}
    assert gaps == {(1, "Brand#12", "5", "2"), (1, "Brand#13", "4", "0"), (1, None, "0", "7"), (3, None, "3", "0")}
    assert sorted(((r.account, r.item, r.internal) for r in dq.recon_orders(spark, path).collect()), key=str) == [(1, "1", "absent"), (3, "2", "open"), (4, None, "absent"), (4, None, "open")]
    codes = {}
    for r in sorted(dq.risk_checks(spark, path).collect(), key=lambda r: r.seq):
        codes.setdefault(r.proposal_id, []).extend([r.code] * (r.status == "block"))
    assert {r.account: (r.by_rules, r.blocking_rules) for r in rows} == {1: (bool(codes[1]), ",".join(codes[1]))}


def test_report_makes_its_bars_once(spark, monkeypatch):
    made, bars = [], dq.panel.daily_bars
    monkeypatch.setattr(dq.panel, "daily_bars", lambda spark, d: made.append(d) or bars(spark, d))
    report_queries.blocks(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_round_trips_are_told_without_the_text(spark):
    texts = ["plain words", "café <|endoftext|> x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.encode(df, queries.vocab_path(), keep=("doc_id",), exact_col="exact")
    assert out.columns == ["doc_id", "n_tokens", "ids", "exact"] and all(r.exact for r in out.collect())
    tokens = bpe.Tokens(open(queries.vocab_path(), encoding="utf-8").read())
    ids, bounds = np.arange(4), np.array([0, 2, 4])
    data, offsets = tokens.decode_many(ids, bounds)
    assert tokens.exact(ids, bounds, data, offsets).all()
    assert tokens.exact(ids[::-1], bounds, data, offsets).tolist() == [False, False]


def test_quality_learns_from_every_labelled_document(spark):
    """Each labelled text is in a group or calibrates, a rare label in every group, and the model does not follow the partitions."""
    seen = []
    texts = [f"good words of plain prose number {i}" if i % 15 else f"%%## ##%% {i} @@@ %%##" for i in range(900)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 15 > 0)) for i in range(900)], "doc_id long, quality int")
    a = quality.train(df, labels, group=100)
    b = quality.train(df.repartition(7), labels.repartition(3), group=100)
    assert np.array_equal(a.model.table, b.model.table) and a.model.temperature == b.model.temperature
    # A single odd text changes the model, whichever it is: nothing is left out.
    for i in (7, 450, 893):
        if not {r.id for r in a.calibration.where(f"id = {i}").collect()}:
            other = df.withColumn("text", F.when(F.col("doc_id") == i, "zzqq xxjj vvkk").otherwise(F.col("text")))
            assert not np.array_equal(quality.train(other, labels, group=100).model.table, a.model.table)
            seen.append(i)
    assert seen
    rows = quality.hierarchical_quality(df, a).collect()
    assert all((r.evidence > 0.5) == (r.doc_id % 15 > 0) for r in rows)


def test_quality_sends_labelled_texts_only_and_joins_alike_at_any_size(spark):
    """Texts without a label stay where they lie, all with one get through; small tables are joined as large ones are."""
    texts = spark.range(20000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    marked = spark.range(0, 20000, 40).select("id", F.lit(1).alias("y"))
    got = {r.id for r in quality._perhaps_labelled(texts.unionByName(texts.limit(1).withColumn("id", F.lit(None).cast("long"))), marked).collect()}
    assert got >= set(range(0, 20000, 40)) and len(got) <= 510
    assert quality._perhaps_labelled(texts, marked.withColumn("id", F.col("id").cast("int"))).count() == 20000
    assert quality._perhaps_labelled(texts, marked.limit(0)).count() == 0
    docs = texts.select(F.col("id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source")).limit(50)
    plan = quality.keep_good(docs, quality.QualityModel(None))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_quality_deals_groups_in_pieces_as_one_by_one(spark, monkeypatch):
    """However many groups a task fits, the model is the same; a rare label stands in several groups, also across pieces and from the last to the first."""
    texts = [f"good words of plain prose number {i}" if i % 15 else f"%%## ##%% {i} @@@ %%##" for i in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 15 > 0)) for i in range(900)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "LEAST", 20)
    found = []
    for together in (1, 2, 4, 100):
        monkeypatch.setattr(quality, "TOGETHER", together)
        found.append(quality.train(df, labels, group=100).model)
    assert all(np.array_equal(m.table, found[0].table) and np.array_equal(m.bias, found[0].bias) and m.temperature == found[0].temperature for m in found)
