"""Components of a similarity relation, without listing all pairs of a group.

``members`` says which nodes stand in which inverted list; two similar nodes
stand in one list at least. Within a list every node is first compared with one
hub (a star), so a group of m copies costs m comparisons, not m^2. What is then
still in several components is compared in blocks, inside tasks, which emit only
pairs that pass the caller's estimate. Every pair of a list is thus either
compared or already connected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import settled

#: Nodes of a list that one task holds at a time from either side.
BLOCK = 2048
#: Another star round follows while this share of the compared pairs were links.
GOING = 0.1


def connected_components(edges: DataFrame) -> DataFrame:
    """Map each node of ``edges`` (a, b) to the smallest node it reaches: (node, label).

    Large-star and small-star steps; each result is a written table, each
    minimum is pre-aggregated before its shuffle. No edges give an empty frame.
    """
    now = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = settled(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
    return settled(now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots), "labels")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def in_blocks(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(grp, key, node, label, side) for every block pair of a key's nodes, m in number: (key, node, label, m) -> rows of which two meet in one grp once."""
    rows = rows.withColumn("nb", F.ceil(F.col("m") / (block or BLOCK)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "key", "node", "label",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
    )


def link_components(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    block_pairs: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame], DataFrame] | None = None,
    max_rounds: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Return (labels: node, label; links: a, b that were confirmed).

    members: (key, node), distinct. verify: pairs (a, b) -> those that are links.
    block_pairs: rows (grp, key, node, label, side) in which ``grp`` is a list's
    block pair and side is 0 (both sides the same block), 1 or 2 -> candidate
    pairs (a, b) of different labels, which ``confirm`` (else verify) decides.
    """
    spark = members.sparkSession
    none = spark.createDataFrame([], "a long, b long")
    links, labels, tested = none, None, none
    for k in range(max_rounds):
        live = _labelled(members, labels)
        order = F.struct("node", "label") if k == 0 else F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node", "label")
        hubs = live.groupBy("key").agg(F.min(order).alias("hub")).select("key", F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label"))
        pairs = live.join(hubs, "key").where("label <> hub_label").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = settled(pairs.join(tested, ["a", "b"], "left_anti") if k else pairs, "pairs")
        n = pairs.count()
        if not n:
            break
        tested = tested.unionByName(pairs)
        found = settled(verify(pairs), "links")
        links = links.unionByName(found)
        got = found.count()
        if got:
            labels = connected_components(links)
        if got < GOING * n:
            break
    live = _labelled(members, labels)
    mixed = live.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi and m > 2").select("key", "m")
    rows = in_blocks(live.join(mixed, "key"))
    pairs = settled(block_pairs(rows).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    found = settled((confirm or verify)(pairs), "links")
    if found.head(1):
        links = links.unionByName(found)
        labels = connected_components(links)
    return (labels if labels is not None else spark.createDataFrame([], "node long, label long")), links
