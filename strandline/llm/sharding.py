"""Operator 10: sharding by a hierarchical weighted hash tree.

A row descends from the root over region and rack to its shard. At each level every
child draws -ln(u) / weight, u being a hash of the row's key and the child's name, and
the least draw wins; so each child gets rows by its weight, and a change of weights moves
only rows into or out of the subtrees whose weights change. Shards beyond the
first tree are regions of their own: one more shard draws beside the old regions
and takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import settled

#: Ranges of the key's hash within a shard, for slot numbers, at least, and the rows of one that are numbered together, about.
RANGES, RANGE_ROWS = 256, 100_000

Tree = dict[str, dict[str, dict[int, float]]]


def tree_of(shards: int, base: int = 8, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None) -> Tree:
    """Regions of racks of shards: the first ``base`` shards fill racks of ``per_rack`` and regions of ``racks``; each further shard is its own region."""
    out: Tree = {}
    for s in range(shards):
        region, rack = (f"r{s // (racks * per_rack)}", f"k{s // per_rack}") if s < base else (f"r+{s}", f"k+{s}")
        out.setdefault(region, {}).setdefault(rack, {})[s] = (weights or {}).get(s, 1.0)
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11) + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, children: list[tuple[str, float]]) -> Column:
    """Number of the child (name, weight) with the least draw."""
    return F.array_min(F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(i).alias("i")) for i, (n, w) in enumerate(children)]))["i"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key (int): three weighted draws, one for each level. Children of no weight get nothing."""
    regions = [(r, sum(sum(x.values()) for x in racks.values()), racks) for r, racks in tree.items()]
    regions = [x for x in regions if x[1] > 0]

    def choose(children, outcomes):
        if len(children) == 1:
            return outcomes[0]
        at = _least(key, children)
        out = F.when(at == 0, outcomes[0])
        for i, o in enumerate(outcomes[1:], 1):
            out = out.when(at == i, o)
        return out

    def in_rack(name, shards):
        live = [(s, w) for s, w in shards.items() if w > 0]
        return choose([(f"{name}/{s}", w) for s, w in live], [F.lit(s) for s, _ in live])

    def in_region(name, racks):
        live = [(k, sum(x.values()), x) for k, x in racks.items() if sum(x.values()) > 0]
        return choose([(f"{name}/{k}", w) for k, w, _ in live], [in_rack(f"{name}/{k}", x) for k, _, x in live])

    return choose([(r, w) for r, w, _ in regions], [in_region(r, racks) for r, _, racks in regions])


def shards_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, founded: int | None = None) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``key``.

    The id and the number of shards alone decide the shard; a null id is a key of its own. grown_shard is
    the shard with one more, which takes rows only into itself. ``founded`` shards (8, or all if there are fewer) filled the tree at first; it stays the same when shards are added. Slots count each shard's rows from 0 without gaps, in order of a hash,
    by counts of hash ranges and row numbers within them. Null texts have no bytes (size 1). Repeated rows get slots of their own. Other columns are not read.
    """
    key, base = F.coalesce(F.col("id").cast("string"), F.lit("null")), founded or min(shards, 8)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = rows.select("id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.cast("long").alias("text_crc32"), place(key, tree_of(shards, base)).cast("int").alias("shard"), place(key, tree_of(shards + 1, base)).cast("int").alias("grown_shard"))
    rows = settled(rows.withColumn("h", F.xxhash64("id", "text_crc32", "size")), "placed")
    ranges = max(RANGES, rows.count() // (shards * RANGE_ROWS))
    rows = rows.withColumn("range", F.pmod("h", F.lit(ranges)).cast("int"))
    counts = rows.groupBy("shard", "range").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "range", before.alias("offset"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "range").orderBy("h", "id")))
    out = numbered.join(offsets, ["shard", "range"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("k") - 1).cast("long").alias("slot"), "grown_shard")
