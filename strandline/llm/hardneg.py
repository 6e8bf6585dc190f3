"""Operator 11: hard-negative mining by coordinate pruning.

Vectors are quantised to integers, and scores are integer inner products. The rows lie in
pieces of bounded size, the anchors in groups of bounded size; each cell of pieces by
groups is one task's work, so neither side has to fit anywhere whole and no key
decides where a row goes. In a cell the rows are sorted by length into buckets whose
lengths differ by a tenth at most. A bucket holds sorted lists of its normalised
coordinates. An anchor that asks for scores of at least s can only be met by unit vectors
whose inner product with its own is s / (anchor's length * bucket's greatest length): a
bucket for which that exceeds 1 is passed over; otherwise it limits each coordinate
to a feasible range. The ranges of the anchor's focus coordinates (its largest ones) are
cut out of the sorted lists, their intersection is the candidate set, and exact integer
products decide. Where the ranges hold most of a bucket, the bucket is verified whole, for
all such anchors in one product.

Two passes: rows of the anchor's label give its positives; their scores are the bounds of
the second pass over rows of other labels. The s that an anchor asks for rises with the
rows that a cell has already found for it, buckets of long vectors coming first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import settled

#: Rows of a piece and anchors of a group, about.
PIECE, GROUP = 1 << 15, 1 << 12
#: Rows of a bucket, and the least ratio of the shortest to the longest vector in it.
BUCKET, RATIO = 1 << 12, 0.9
#: Focus coordinates, and the share of a bucket above which a candidate set is not worth its making.
FOCUS, DENSE = 4, 0.25

_LONG = np.iinfo(np.int64)


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, noise: Column | None) -> DataFrame:
    """(id, label, q): floor(scale * x) of each component, of rows with a label and finite components."""
    v = F.col(vector_col)
    fit = F.col(label_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(label_col).cast("long")
    return df.where(fit).select(
        F.col(id_col).cast("long").alias("id"), (label if noise is None else F.when(noise, (label + 1) % 10).otherwise(label)).alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("q")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers [rows, width] as doubles, shorter ones filled with 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products [len(a), len(b)] as int64; beyond 64 bits the nearest long."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


class Buckets:
    """Rows of a cell by falling length, cut into buckets, each with sorted lists of its normalised coordinates."""

    def __init__(self, q: np.ndarray):
        length = np.sqrt((q * q).sum(axis=1))
        self.order = np.argsort(-length, kind="stable")
        self.q, self.length = q[self.order], length[self.order]
        self.cuts, at = [], 0
        while at < len(q):
            end = int(np.searchsorted(-self.length, -RATIO * self.length[at], "right"))
            end = min(max(end, at + 1), at + BUCKET, len(q))
            self.cuts.append((at, end))
            at = end
        self._lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, bucket: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, values): normalised coordinate ``f`` of the bucket's rows, ascending."""
        if (bucket, f) not in self._lists:
            a, b = self.cuts[bucket]
            x = self.q[a:b, f] / np.maximum(self.length[a:b], 1e-300)
            order = np.argsort(x, kind="stable")
            self._lists[bucket, f] = order.astype(np.int32), x[order]
        return self._lists[bucket, f]

    def candidates(self, bucket: int, unit: np.ndarray, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Rows of the bucket that the feasible ranges of all focus coordinates leave for cosines of ``least`` and more; None if too many to tell."""
        a, b = self.cuts[bucket]
        found, slack = [], np.sqrt(max(0.0, 1 - least * least))
        for f in focus.tolist():
            x = unit[f]
            reach = np.sqrt(max(0.0, 1 - x * x)) * slack + 1e-9
            # A cap that holds the axis itself reaches to its end.
            low, high = -np.inf if x < -least else x * least - reach, np.inf if x > least else x * least + reach
            rows, values = self.sorted_list(bucket, f)
            s, e = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            found.append((e - s, s, e, rows))
        found.sort(key=lambda x: x[0])
        if found[0][0] > DENSE * (b - a):
            return None
        seen = np.zeros(b - a, np.int8)
        for _, s, e, rows in found:
            seen[rows[s:e]] += 1
        return np.flatnonzero(seen == len(found))


def search(anchors: np.ndarray, asked: np.ndarray, rows: Buckets, take) -> None:
    """Calls take(anchor numbers, row numbers, scores) with all pairs whose score is at least what the anchor asks for (others may come, too).

    ``asked`` [anchors] is read anew for each bucket: ``take`` may raise it. -inf asks for every row.
    """
    length = np.sqrt((anchors * anchors).sum(axis=1))
    unit = anchors / np.maximum(length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
    for k, (a, b) in enumerate(rows.cuts):
        top = rows.length[a] * length
        with np.errstate(invalid="ignore", divide="ignore"):
            least = np.where(asked <= 0, -1.0, np.where(top > 0, asked / top, np.inf)) - 1e-9
        live = np.flatnonzero(least <= 1)
        whole = []
        for i in live.tolist():
            few = rows.candidates(k, unit[i], focus[i], min(1.0, float(least[i]))) if least[i] > 0 else None
            if few is None:
                whole.append(i)
            elif len(few):
                s = _products(anchors[i : i + 1], rows.q[a + few])[0]
                take(np.full(len(few), i), rows.order[a + few], s)
        for at in range(0, len(whole), 256):
            ids = np.array(whole[at : at + 256])
            s = _products(anchors[ids], rows.q[a:b])
            i, j = np.nonzero(s >= asked[ids][:, None])
            take(ids[i], rows.order[a + j], s[i, j])


class _Best:
    """The first ``k`` rows of each slot, by falling score and rising id (null last)."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot = self.row = np.zeros(0, np.int64)
        self.score, self.ident = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        slot, row, score, ident = (np.concatenate(x) for x in ((self.slot, slot), (self.row, row), (self.score, score), (self.ident, ident)))
        order = np.lexsort((ident, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        keep = order[place < self.k]
        self.slot, self.row, self.score, self.ident = slot[place < self.k], row[keep], score[keep], ident[keep]

    def floor(self) -> np.ndarray:
        """[slots] the k-th score, -inf while there are fewer."""
        out = np.full(self.slots, -np.inf)
        n = np.bincount(self.slot, minlength=self.slots)
        last = np.cumsum(n) - 1
        full = n == self.k
        out[full] = self.score[last[full]]
        return out


def _cell(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The first rows of the label of each anchor in one cell; if anchors have ``bounds``, the first rows of other labels for each bound."""
    names = ["anchor", "slot", "row", "score"]
    empty = pa.table([pa.array([], pa.int64())] * 4, names=names)
    if not len(anchors) or not len(rows):
        return empty
    anchors, rows = anchors.combine_chunks(), rows.combine_chunks()
    column = lambda t, c: t.column(c).combine_chunks()
    width = max(int(column(t, "q").value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in (anchors, rows))
    x, y = _matrix(column(anchors, "q"), width), _matrix(column(rows, "q"), width)
    positives = "bounds" not in anchors.column_names
    no, aid, alab = (anchors.column(c).to_numpy() for c in ("no", "id", "label"))
    ident = np.asarray(column(rows, "id").fill_null(_LONG.max))
    label = rows.column("label").to_numpy()
    per = 1 if positives else column(anchors, "bounds").value_lengths().to_numpy(zero_copy_only=False).max(initial=0)
    best = _Best(len(x) * per, k)
    if positives:
        for own in np.unique(alab).tolist():
            mine, theirs = np.flatnonzero(alab == own), np.flatnonzero(label == own)
            if not len(theirs):
                continue
            asked = np.full(len(mine), -np.inf)

            def take(i, j, s):
                ok = (aid[mine[i]] != ident[theirs[j]]) & (s >= asked[i])
                best.add(mine[i[ok]], theirs[j[ok]], s[ok], ident[theirs[j[ok]]])
                asked[:] = best.floor()[mine]

            search(x[mine], asked, Buckets(y[theirs]), take)
    else:
        bounds = np.full((len(x), per), -1, np.int64)
        sizes = column(anchors, "bounds").value_lengths().to_numpy(zero_copy_only=False)
        bounds[np.arange(per)[None, :] < sizes[:, None]] = column(anchors, "bounds").flatten().to_numpy()
        # What a negative must score at least: low / high hundredths of the positive, rounded up. Below 0 no score is in range.
        lowest = np.where(bounds >= 0, -(-bounds * low // high), _LONG.max).astype(float)
        lowest[bounds < 0] = np.inf
        asked = lowest.min(axis=1)

        def take(i, j, s):
            ok = (alab[i] != label[j]) & (s <= bounds[i].max(axis=1)) & (s >= asked[i])
            i, j, s = i[ok], j[ok], s[ok]
            for p in range(per):
                fits = (high * s >= low * bounds[i, p]) & (s <= bounds[i, p]) & (bounds[i, p] >= 0)
                best.add(i[fits] * per + p, j[fits], s[fits], ident[j[fits]])
            asked[:] = np.maximum(lowest, best.floor().reshape(-1, per)).min(axis=1)

        search(x, asked, Buckets(y), take)
    return pa.table([pa.array(no[best.slot // per]), pa.array(best.slot % per), pa.array(ident[best.row], mask=ident[best.row] == _LONG.max), pa.array(best.score)], names=names)


def _cells(anchors: DataFrame, rows: DataFrame, pieces: int, groups: int, cell) -> DataFrame:
    """``cell`` over each piece of rows and group of anchors: both sides are copied as the grid asks, nothing is broadcast."""
    left = anchors.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    right = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return left.groupBy("piece", "grp").cogroup(right.groupBy("piece", "grp")).applyInArrow(cell, "anchor long, slot long, row long, score long")


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, noise: Column | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchor`` (of ``df``'s columns) holds.

    An anchor's positives are its first rows of the same label and another id, by falling score, ties by
    rising id; its negatives for one of them the first rows of other labels with low * positive <= high * negative
    <= high * positive. Rows with a null label, a null vector, or a null or non-finite component take no part,
    as anchor or as row; a null id is never an anchor and comes last among ties. Vectors
    of different lengths compare by the components that both have; empty ones score 0. Repeated rows each count
    as found rows; as anchors, rows of the same id, label and vector count once, and different rows of one id are each mined,
    all under that id. Scores beyond 64 bits become the nearest long. Fewer rows than asked for give what there is, an empty
    table none. Other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    base = settled(quantised(df, id_col, vector_col, label_col, scale, noise), "vectors")
    chosen = settled(quantised(df.where(anchor & F.col(id_col).isNotNull()), id_col, vector_col, label_col, scale, noise).distinct().withColumn("no", F.monotonically_increasing_id()), "anchors")
    n, m = base.count(), chosen.count()
    many = max(1, -(-n // PIECE), min(2 * spark.sparkContext.defaultParallelism, n // 1024))
    groups = max(1, -(-m // GROUP))
    # Dealt by turns, so pieces are even whatever the rows hold; once written, their numbers stay.
    rows = settled(base.repartition(many).withColumn("piece", F.spark_partition_id()), "pieces")
    anchors = settled(chosen.repartition(groups).withColumn("grp", F.spark_partition_id()), "groups")

    by = lambda *c: Window.partitionBy(*c).orderBy(F.desc("score"), F.col("row").isNull(), "row")
    found = _cells(anchors, rows, many, groups, lambda a, b: _cell(a, b, positives, low, high))
    nearest = settled(found.withColumn("p", F.row_number().over(by("anchor"))).where(F.col("p") <= positives), "positives")
    bounds = nearest.groupBy(F.col("anchor").alias("no")).agg(F.sort_array(F.collect_list(F.struct("p", "score"))).alias("x"))
    asking = anchors.join(bounds, "no").select("no", "id", "label", "q", "grp", F.col("x.score").alias("bounds"))
    found = _cells(asking, rows, many, groups, lambda a, b: _cell(a, b, negatives, low, high))
    ranked = found.withColumn("rank", F.row_number().over(by("anchor", "slot"))).where(F.col("rank") <= negatives)
    pairs = nearest.select(F.col("anchor").alias("a"), (F.col("p") - 1).cast("long").alias("s"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("no").alias("n"), F.col("id").alias("anchor_id"))
    out = ranked.join(pairs, (F.col("anchor") == F.col("a")) & (F.col("slot") == F.col("s"))).join(names, F.col("anchor") == F.col("n"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same in DuckDB's SQL: rows whose id is divisible by ``every`` are anchors.
ORACLE = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.id as a, r.id as r, a.label = r.label as same, list_inner_product(a.q, r.q)::bigint as s
  from v a join v r on a.id <> r.id where a.id % 100 = 0),
p as (
  select a, r, s, row_number() over (partition by a order by s desc, r) as k from s where same qualify k <= 5),
n as (
  select p.a as anchor_id, p.r as positive_id, row_number() over (partition by p.a, p.r order by s.s desc, s.r)::int as rank,
    s.r as negative_id, p.s as positive_score, s.s as negative_score
  from p join s on p.a = s.a and not s.same and 80 * p.s <= 100 * s.s and s.s <= p.s)
select * from n where rank <= 5
"""
