"""Operator 4: near-duplicate detection from bottom-k MinHash sketches.

One hash function orders all shingles. A document's sketch is the ``k`` smallest
hashes of its distinct shingles. Inverted lists of retained values (the first
``LISTED``) generate the overlapping documents: a list is keyed by a run of consecutive ones.
If two sets have a Jaccard similarity of t, so few of the union's values belong
to only one of them that some run of r = t / (1 - t) consecutive values is
common (shorter runs for tiny sets; see ``run_lengths``): with sets of at most
``LISTED`` shingles that always holds, with longer ones it fails with a
probability below 1e-5 at exactly t = 0.8 and 64 values, and far less above it. The
union sketch of a pair (the k smallest of both) then estimates the similarity,
five standard errors below the threshold being the least that passes, and the
exact Jaccard of the full sets decides. Equal sets are one class and are never
paired. A shingle and a set of shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._links import link_components
from ._work import settled
from ._words import mix, shingle_sets, text_slices, word_hashes

_FULL = np.iinfo(np.int32).max
#: Retained values that lists are made of, and all retained values.
LISTED, RETAINED = 64, 256


@lru_cache(4096)
def run_lengths(n: int, percent: int) -> tuple[int, ...]:
    """Lengths of runs that a set of ``n`` values must be listed under.

    For a union of u values, i = ceil(t u) of them common, the u - i others cut the
    common ones into u - i + 1 runs at most, so the longest has ceil(i / (u - i + 1)).
    """
    most = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    found = set()
    for u in range(n, n * 100 // percent + 1):
        i = -(-percent * u // 100)
        found.add(min(most, -(-i // (u - i + 1))))
    return tuple(sorted(found))


def _lengths(n: int, percent: int, k: int) -> tuple[int, ...]:
    return run_lengths(n if n <= k else 100 * k, percent)


def _run_keys(sketch: np.ndarray, length: int) -> np.ndarray:
    s = sketch.astype(np.int64).view(np.uint64)
    if len(s) < length:
        return np.zeros(0, np.int64)
    h = s[: len(s) - length + 1] + np.uint64(length)
    for k in range(1, length):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[k : len(s) - length + 1 + k])
    return h.view(np.int64)


def _set_digest(values: np.ndarray) -> int:
    v = values.view(np.uint64)
    total = np.array([mix(v).sum(dtype=np.uint64) ^ (mix(v + np.uint64(1)).sum(dtype=np.uint64) << np.uint64(1)) ^ np.uint64(len(v))])
    return int(mix(total).view(np.int64)[0])


def _lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, kind)))


def _sets(batch: pa.RecordBatch, text: str, width: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_slices(batch.column(text)):
        yield from shingle_sets(*word_hashes(data, offsets), width)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n, node, sketch) per row; node is the digest of the set, null when it is empty.

    A sketch holds the upper halves of the k smallest hashes, in order.
    """

    def run(batches):
        for batch in batches:
            n, node, low = [], [], []
            for s in _sets(batch, "text", width):
                n.append(len(s))
                node.append(_set_digest(s) if len(s) else None)
                low.append((s[:k] >> 32).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), _lists(low, np.int32)], ["id", "n", "node", "sketch"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, node long, sketch array<int>")


def union_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, k: int) -> np.ndarray:
    """Which pairs of padded sketches [pairs, k] can reach the threshold.

    Pairs whose sets both lie whole in their sketches are decided by these alone.
    """
    s = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = (s[:, 1:] == s[:, :-1]) & (s[:, 1:] != _FULL)
    rank = np.arange(1, s.shape[1])[None, :] - np.cumsum(same, axis=1) + same
    shared = (same & (rank <= k)).sum(axis=1)
    whole = (na <= k) & (nb <= k)
    common = same.sum(axis=1)
    t = percent / 100
    least = (t - 5 * np.sqrt(t * (1 - t) / k)) * k
    return np.where(whole, 100 * common >= percent * (na + nb - common), shared >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _padded(column: pa.Array, k: int) -> np.ndarray:
    out = np.full((len(column), k), _FULL, np.int32)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(k)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _estimated(pairs: DataFrame, table: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) that pass the union-sketch estimate, by two joins with the sketches."""
    left = table.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = table.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 8192):
                x = batch.slice(at, 8192)
                ok = union_estimate(_padded(x.column("sa"), k), _padded(x.column("sb"), k), x.column("na").to_numpy(), x.column("nb").to_numpy(), percent, k)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _row_keys(sketch: np.ndarray, n: np.ndarray, percent: int, k: int) -> np.ndarray:
    """Keys of each padded sketch's runs [rows, any], padded with distinct fillers."""
    found = [np.concatenate([_run_keys(row[: min(size, k)], x) for x in _lengths(size, percent, k)] or [np.zeros(0, np.int64)]) for row, size in zip(sketch, n.tolist())]
    out = np.tile(np.arange(len(found), dtype=np.int64)[:, None] - (1 << 62), (1, max((len(x) for x in found), default=0)))
    for i, x in enumerate(found):
        out[i, : len(x)] = x
    return out


def _block_pairs(rows: DataFrame, table: DataFrame, percent: int, k: int) -> DataFrame:
    """Candidate pairs of each block pair: groups arrive whole, one after the other, of 2 BLOCK rows at most (on average).

    The listed values give a first estimate; of the lists that a pair has in common, only
    that with the least key emits it, if all retained values let it pass, too.
    """

    def emit(key, label, side, node, n, sk):
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        keys = None
        per = max(1, 100_000 // max(1, len(right)))
        for at in range(0, len(left), per):
            i, j = (x.ravel() for x in np.meshgrid(left[at : at + per], right, indexing="ij"))
            ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((side[i] != side[j]) | (i < j)) & ((side[i] == 0) == (side[j] == 0))
            i, j = i[ok], j[ok]
            for b in range(0, len(i), 8192):
                p, q = i[b : b + 8192], j[b : b + 8192]
                good = union_estimate(sk[p, :LISTED], sk[q, :LISTED], n[p], n[q], percent, LISTED)
                p, q = p[good], q[good]
                if not len(p):
                    continue
                keys = _row_keys(sk, n, percent, LISTED) if keys is None else keys
                both = np.sort(np.concatenate([keys[p], keys[q]], axis=1), axis=1)
                first = np.argmax((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= -(1 << 62) + len(keys)) | (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < -(1 << 62)), axis=1)
                mine = both[np.arange(len(p)), first] == key[0]
                p, q = p[mine], q[mine]
                good = union_estimate(sk[p], sk[q], n[p], n[q], percent, k)
                x, y = node[p[good]], node[q[good]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("grp", "key", "label", "side", "node", "n")] + [_padded(batch.column("sketch"), k)]
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)] if held else cols
            if not len(cols[0]):
                continue
            cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            starts = [0, *cuts.tolist()]
            for s, e in zip(starts[:-1], starts[1:]):
                yield from emit(*(c[s:e] for c in cols[1:]))
            held = [c[starts[-1] :] for c in cols]
        if held:
            yield from emit(*held[1:])

    joined = rows.join(table.select("node", "n", "sketch"), "node").repartition("grp").sortWithinPartitions("grp", "key")
    return joined.select("grp", "key", "label", "side", "node", "n", "sketch").mapInArrow(run, "a long, b long")


def _components(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, node, sketch) of every row, and (node, id, label) of every class of equal sets."""
    rows = settled(sketches(df, id_col, text_col, width, k), "sketches")
    table = settled(
        rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n", "sketch")).alias("x")).select("node", F.col("x.id").alias("id"), F.col("x.n").alias("n"), F.col("x.sketch").alias("sketch")),
        "classes",
    )

    def keys(batches):
        for batch in batches:
            sizes, found, node = batch.column("n").to_numpy(), [], []
            ends = batch.column("sketch").offsets.to_numpy()
            flat = batch.column("sketch").values.to_numpy()
            for x, size, s, e in zip(batch.column("node").to_pylist(), sizes.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                for length in _lengths(size, percent, LISTED):
                    found.append(_run_keys(flat[s : min(e, s + LISTED)], length))
                    node.append(np.full(len(found[-1]), x, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(node))], ["key", "node"])

    listed = table.select("node", "n", "sketch").mapInArrow(keys, "key long, node long").distinct()
    several = listed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = settled(listed.join(several, "key"), "members")

    wanted = table.join(members.select("node").distinct(), "node", "left_semi").select(F.col("id").alias("rep"), F.col("node").alias("want"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def full(batches):
        for batch in batches:
            found = [(w, s) for w, s in zip(batch.column("want").to_pylist(), _sets(batch, "text", width)) if len(s) and _set_digest(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), _lists([s for _, s in found])], ["node", "set"])

    sets = settled(wanted.join(texts, F.col("rep").eqNullSafe(F.col("id"))).select("want", "text").mapInArrow(full, "node long, set array<long>").dropDuplicates(["node"]), "sets")

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.withColumn("i", common).where(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")

    labels, _ = link_components(members, lambda pairs: exact(_estimated(pairs, table, percent, k)), lambda r: _block_pairs(r, table, percent, k), exact)
    return rows, table.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = RETAINED) -> DataFrame:
    """Components of documents with a Jaccard similarity of ``percent`` / 100 or more.

    Returns (id_col, n_shingles, component_id, kept) for each row: the size of its
    set of distinct ``width``-word shingles, the smallest id it reaches over links,
    and whether that is its own. A text of fewer words is one shingle. Null, empty and
    blank texts have empty sets and link with nothing: their component is their own id.
    Repeated rows come back as often as they came, all in one component; an id with
    several texts is judged text by text. A null id is passed over by the minimum;
    where all ids of a component are null, component_id is null and kept is true.
    Other columns of ``df`` are not read, whatever their names. An empty table gives none.
    """
    rows, joined = _components(df, id_col, text_col, width, percent, k)
    least = joined.groupBy("label").agg(F.min("id").alias("component"))
    by_node = joined.join(least, "label").select("node", "component")
    out = rows.drop("sketch").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _with_node(df: DataFrame, text_col: str, width: int) -> DataFrame:
    """``df`` and the digest of each row's set, ``__node``."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            node = [_set_digest(s) if len(s) else None for s in _sets(pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], ["text"]), "text", width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], [*batch.schema.names, "__node"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__node", T.LongType())]))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = RETAINED) -> DataFrame:
    """The rows of ``df`` without near copies: of each component, the document with the smallest id (null last) stays, of several with it the one with the smallest digest.

    Rows are judged by their texts: an id with several texts can stay several times. Of rows that repeat id and set, one stays; rows
    without shingles stay, repeated ones once unless their id is null. Columns are those of ``df``.
    """
    rows, joined = _components(df, id_col, text_col, width, percent, k)
    best = joined.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("x")).select(F.col("x.id").alias("__id"), F.col("x.node").alias("__kept"))
    alone = rows.where("node is null").select(F.col("id").alias("__id"), F.col("node").alias("__kept")).distinct()
    kept = settled(best.unionByName(alone), "kept")
    out = _with_node(df, text_col, width).join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & F.col("__node").eqNullSafe(F.col("__kept")), "left_semi")
    # Rows without id and shingles are told apart by a number of their own.
    own = F.when(F.col(id_col).isNull() & F.col("__node").isNull(), F.monotonically_increasing_id())
    return out.withColumn("__own", own).dropDuplicates([id_col, "__node", "__own"]).select(*df.columns)
