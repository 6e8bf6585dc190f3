"""Operator 6: mixing sources to target weights, in DataFrame operations only.

Each source's target in words follows its weight, up to a multiple of its size; the
excess goes to the others by weight. What a target holds of complete epochs, every
document gives; the rest is an Efraimidis-Spirakis sample: documents sorted within
their source by -ln(u) / w (u a hash of the id, w the document's quality weight),
taken as long as the prefix sum of their words fits. The prefix sums are two-level,
over ranges of the key and within them, so a source of any share is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import settled

WORDS = r"[^\x20\x09-\x0D]+"
#: Ranges of the sampling key within a source.
RANGES = 1024
CAP = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, cap: int = CAP, cycle: int = 3) -> DataFrame:
    """(source, size, target) of one row per source: shares of all sizes by weights 1 .. ``cycle``, repeating in order of the source, null last.

    Filled up to cap * size in order of cap * size / weight: a source stops there if its share of what is left is more.
    The share rises over the sources that stop and falls after them, so the greatest that holds is the level of the others.
    """
    rank = F.row_number().over(Window.orderBy(F.col(source).isNull(), F.col(source)))
    s = sizes.withColumn("__w", (rank - 1) % cycle + 1).withColumn("__full", F.col(size) * cap)
    before = Window.orderBy(F.col("__full") / F.col("__w"), F.col(source).isNull(), F.col(source)).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(size).over(everything) - F.coalesce(F.sum("__full").over(before), F.lit(0))
    weight = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    s = s.withColumn("__share", left / weight)
    level = F.max(F.when(F.col("__full") / F.col("__w") >= F.col("__share"), F.col("__share"))).over(everything)
    return s.select(source, size, F.least(F.col("__full").cast("double"), F.col("__w") * level).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, seed: str = "mix", cut: bool = True) -> DataFrame:
    """(id_col, size, source_size, target, taken, epochs, part) of every row.

    taken = epochs * size + part, in words. The document at the border of the sample
    gives the part that still fits when ``cut``; otherwise all of its words if half of them
    fit, else none. Null texts have no words; a null source is a source of its own. ``weights`` (id_col, weight; unique ids)
    holds quality weights; ids without one, and weights that are null or not above 0, count as 1.
    The draw is a hash of ``seed`` and the id: reruns agree, and repeated rows draw alike
    (they are still rows of their own, ordered by size). An empty table gives none; a source without words takes 0.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    # Words are counted before any shuffle: texts stay where they are.
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = settled(rows, "words").join(weights.select(F.col(id_col).alias("id"), F.col("weight").cast("double").alias("weight")), "id", "left")
    rows = settled(rows.select("id", "source", "size", (-F.log(u) / F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)).alias("key")), "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source", "source_size")
    whole = F.round("target").cast("long")
    goals = goals.withColumn("epochs", F.coalesce(F.expr("cast(round(target) as bigint) div nullif(source_size, 0)"), F.lit(0)).cast("long")).withColumn("rest", F.coalesce(whole - F.col("epochs") * F.col("source_size"), F.lit(0)))

    rows = rows.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * RANGES).cast("int"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("s"))
    earlier = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("s1"), F.col("range").alias("r1"), earlier.alias("offset"))
    per_range = offsets.join(goals, F.col("s1").eqNullSafe(F.col("source"))).drop("source")
    inside = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("ahead", F.coalesce(inside, F.lit(0)))
    out = placed.join(per_range, F.col("source").eqNullSafe(F.col("s1")) & (F.col("range") == F.col("r1")))
    start = F.col("offset") + F.col("ahead")
    fits = F.least(F.greatest(F.col("rest") - start, F.lit(0)), F.col("size"))
    part = fits if cut else F.when(2 * fits >= F.col("size"), F.col("size")).otherwise(0)
    return out.withColumn("part", part.cast("long")).select(
        F.col("id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part"
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` as the mix takes them: once for each epoch and once if sampled (whole documents); documents without words never.

    Ids should be unique; of repeated ones, each row comes as often as any of them is taken.
    """
    plan = mix(df, id_col, cut=False, **options).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("epochs") + (F.col("part") > 0).cast("long")).alias("__n"), F.max("size").alias("__size")).where("__n > 0 and __size > 0")
    return df.join(plan, F.col(id_col).eqNullSafe(F.col("__id"))).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*df.columns)


#: The same in DuckDB's SQL, for ids that are unique or null.
ORACLE = rf"""
with q as (select doc_id, max(quality) as quality from labels group by doc_id),
rows as (
  select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) as size,
    -ln((('0x' || substr(md5('mix:' || coalesce(cast(d.doc_id as varchar), '')), 1, 13))::bigint + 0.5) / 4503599627370496.0)
      / (case q.quality when 1 then 2.0 when 0 then 0.5 else 1.0 end) as key
  from documents d left join q on d.doc_id = q.doc_id),
s as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source is null, source) - 1) % 3 + 1 as w
  from rows group by source),
f as (
  select *, {CAP} * source_size as top,
    (sum(source_size) over () - coalesce(sum({CAP} * source_size) over o, 0))::double / (sum(w) over () - coalesce(sum(w) over o, 0))::double as share
  from s window o as (order by {CAP} * source_size::double / w, source is null, source rows between unbounded preceding and 1 preceding)),
g as (select source, source_size, least(top::double, w * max(case when top::double / w >= share then share end) over ()) as target from f),
h as (
  select *, case when source_size > 0 then round(target)::bigint // source_size else 0 end as epochs from g),
p as (
  select r.doc_id, r.size, h.source_size, h.target, h.epochs,
    case when h.source_size > 0 then round(h.target)::bigint - h.epochs * h.source_size else 0 end as rest,
    coalesce(sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from rows r join h on r.source is not distinct from h.source)
select doc_id, size::bigint as size, source_size, round(target, 6) as target,
  (epochs * size + least(greatest(rest - start, 0), size))::bigint as taken,
  epochs::bigint as epochs, least(greatest(rest - start, 0), size)::bigint as part
from p
"""
