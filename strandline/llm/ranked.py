"""Operator 12: ranked lexical search with Block-Max MaxScore.

The index is built in one pass without a shuffle: each task cuts its documents into shards
of bounded size and writes, for every term of a shard, its postings in blocks of
``BLOCK``: compressed places and frequencies, and beside them, uncompressed, each block's
last place and the pairs (frequency, document length) that bound its scores whatever the
collection's statistics are. Documents of a shard stand in order of their ids, so places
break ties.

A search gets the terms' statistics from the index's small columns, then meets each
shard with each group of items. In a shard an item's lists are sorted by their bounds.
Those whose bounds together cannot reach the 20th best score found so far (threshold) are
non-essential: only the essential lists propose documents, window by window. A
proposed document goes on through the non-essential lists, strongest first: the maximum of
the block that would hold it, read from the uncompressed side, tells whether it can
still reach the threshold; only blocks that hold such documents are decompressed. The heaps of
the shards are merged by one window over (item, shard) winners.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._terms import term_spans, term_strings
from ._words import text_slices
from ._work import settled

#: Postings of a block, documents of a shard at most, bytes of text of a shard (or one document), items of a group.
BLOCK, SHARD_DOCUMENTS, SHARD_BYTES, ITEMS = 128, 1 << 16, 1 << 24, 512
#: Documents of the first window and of the largest.
FIRST_WINDOW, LAST_WINDOW = 256, 8192

#: Bytes that end a term: ASCII but for letters and digits.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[128:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _SEPARATOR[_a:_b] = False

_INDEX = "shard long, term string, df long, docs long, terms long, ends binary, peaks binary, cuts binary, data binary"


def _packed(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, width of each block) of whole numbers in the least of 1, 2, 4 or 8 bytes that holds the block's largest."""
    top = np.maximum.reduceat(values, firsts) if len(values) else np.zeros(0, np.int64)
    width = np.select([top < 1 << 8, top < 1 << 16, top < 1 << 32], [1, 2, 4], 8)
    sizes = np.diff(np.append(firsts, len(values)))
    each = np.repeat(width, sizes)
    at = np.cumsum(each) - each
    out = np.zeros(int(each.sum()), np.uint8)
    for b in range(int(width.max(initial=0))):
        some = each > b
        out[at[some] + b] = (values[some] >> (8 * b)) & 255
    return out, width


def _shard(number: int, ids: np.ndarray, sizes: np.ndarray, docs: np.ndarray, terms: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """The index rows of one shard: (document, term) of every token; the first row holds ids and lengths."""
    order = np.lexsort((ids, ids == np.iinfo(np.int64).max))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    key = terms.astype(np.int64) * max(1, len(ids))
    key += place[docs]
    del terms, docs
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // max(1, len(ids)), key % max(1, len(ids))
    length = sizes[order][doc]
    heads = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(key) else np.zeros(0, np.int64)
    df = np.diff(np.append(heads, len(key)))
    inside = np.arange(len(key)) - np.repeat(heads, df)
    firsts = np.flatnonzero(inside % BLOCK == 0)
    count = np.diff(np.append(firsts, len(key)))
    # Places as differences to the block's first one, whose own stands in front of the block.
    gap = doc - np.repeat(doc[firsts], count)
    places, pw = _packed(gap, firsts)
    times, tw = _packed(tf, firsts)
    start_p, start_t = np.append(0, np.cumsum(pw * count)), np.append(0, np.cumsum(tw * count))
    data = np.zeros(len(places) + len(times), np.uint8)
    at = start_p[:-1] + start_t[:-1]
    mark = np.zeros(len(data) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + pw * count, -1)
    own = np.cumsum(mark[:-1]).astype(bool)
    data[own], data[~own] = places, times
    # Bounds: the shortest document with a frequency of 1; the highest frequency and the shortest document beyond it.
    big = np.iinfo(np.int64).max
    single = np.minimum.reduceat(np.where(tf == 1, length, big), firsts) if len(firsts) else firsts
    more = np.minimum.reduceat(np.where(tf > 1, length, big), firsts) if len(firsts) else firsts
    peak = np.stack([single, np.maximum.reduceat(tf, firsts) if len(firsts) else firsts, more], axis=1) if len(firsts) else np.zeros((0, 3), np.int64)
    cuts = np.stack([doc[firsts], count, pw, tw, at], axis=1) if len(firsts) else np.zeros((0, 5), np.int64)
    ends = doc[np.append(firsts[1:], len(key)) - 1] if len(firsts) else firsts
    blocks = np.searchsorted(firsts, np.append(heads, len(key)))
    limit = np.append(at, len(data))

    def binary(array: np.ndarray, bounds: np.ndarray) -> pa.Array:
        raw = np.ascontiguousarray(array)
        step = raw.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
        return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * step).astype(np.int64)), pa.py_buffer(raw)])

    n = len(heads)
    none = lambda kind: pa.nulls(1, kind)
    cat = lambda first, rest: pa.concat_arrays([first, rest])
    cuts[:, 4] -= np.repeat(at[blocks[:-1]], np.diff(blocks)) if n else 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number)), cat(none(pa.large_string()), words.take(pa.array(term[heads]))).cast(pa.string()), cat(none(pa.int64()), pa.array(df)),
            cat(pa.array([int((sizes > 0).sum())]), pa.nulls(n, pa.int64())), cat(pa.array([int(sizes.sum())]), pa.nulls(n, pa.int64())),
            cat(pa.array([ids[order].tobytes()], pa.large_binary()), binary(ends, blocks)).cast(pa.binary()), cat(pa.array([sizes[order].tobytes()], pa.large_binary()), binary(peak, blocks)).cast(pa.binary()),
            cat(none(pa.large_binary()), binary(cuts, blocks)).cast(pa.binary()), cat(none(pa.large_binary()), binary(data, limit[blocks])).cast(pa.binary()),
        ],
        ["shard", "term", "df", "docs", "terms", "ends", "peaks", "cuts", "data"],
    )


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows and all terms of whole texts, as a written table.

    One row a shard without a term (ids and lengths of its documents), and one row a term and shard. Null
    texts have no terms; rows are documents of their own, also with equal or null ids (null comes last).
    A task holds one shard at a time.
    """

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, sizes, docs, terms, kinds, bytes_, known, n = [], [], [], [], [], 0, {}, 0

        def flush():
            words = pa.concat_arrays(kinds) if kinds else pa.array([], pa.large_string())
            # Each slice has its own dictionary: one more encoding numbers the terms of the shard.
            coded = words.dictionary_encode()
            to = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.concatenate(terms) if terms else np.zeros(0, np.int32)
            return _shard(number, np.concatenate(ids), np.concatenate(sizes), np.concatenate(docs) if docs else np.zeros(0, np.int32), to[of], coded.dictionary)

        for batch in batches:
            own = np.asarray(batch.column("id").fill_null(np.iinfo(np.int64).max))
            for first, last, data, offsets in text_slices(batch.column("text")):
                at, to, bounds = term_spans(data, offsets, _SEPARATOR)
                coded = term_strings(data, at, to).dictionary_encode()
                base = sum(map(len, kinds))
                ids.append(own[first:last])
                sizes.append(np.diff(bounds).astype(np.int64))
                docs.append(np.repeat(np.arange(n, n + last - first, dtype=np.int32), np.diff(bounds)))
                terms.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(base))
                kinds.append(coded.dictionary)
                n, bytes_ = n + last - first, bytes_ + len(data)
                if n >= SHARD_DOCUMENTS or bytes_ >= SHARD_BYTES:
                    yield flush()
                    ids, sizes, docs, terms, kinds, bytes_, n = [], [], [], [], [], 0, 0
                    number += 1
        if ids:
            yield flush()

    return settled(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _INDEX), "index")


class _List:
    """A term's postings in one shard."""

    def __init__(self, ends: bytes, peaks: bytes, cuts: bytes, data: bytes):
        self.ends = np.frombuffer(ends, np.int64)
        self.peaks = np.frombuffer(peaks, np.int64).reshape(-1, 3)
        self.cuts = np.frombuffer(cuts, np.int64).reshape(-1, 5)
        self.data = data
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, frequencies), decompressed once for each shard and group of items."""
        if b not in self.open:
            first, n, pw, tw, at = self.cuts[b].tolist()
            kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
            self.open[b] = np.frombuffer(self.data, kind[pw], n, at).astype(np.int64) + first, np.frombuffer(self.data, kind[tw], n, at + pw * n).astype(np.int64)
        return self.open[b]

    def blocks(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(b) for b in numbers.tolist()]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class Searcher:
    """One shard's lists, and the statistics of the whole collection."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, lists: dict[str, _List], docs: int, terms: int):
        self.ids, self.lists = ids, lists
        self.docs, self.terms = docs, terms
        self.m = self.norm(lengths)
        self.best = {t: np.maximum(self.impact(1, self.norm(x.peaks[:, 0]), x.peaks[:, 0]), self.impact(x.peaks[:, 1], self.norm(x.peaks[:, 2]), x.peaks[:, 2])) for t, x in lists.items()}

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 75 + 25 * np.minimum(n, 1 << 40) * self.docs // max(1, self.terms)

    @staticmethod
    def impact(tf, m: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
        """(10^9 tf) div (1000 tf + 12 m); 0 where a block holds no such document."""
        x = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        return x if there is None else np.where(there == np.iinfo(np.int64).max, 0, x)

    def top(self, query: list[tuple[str, int]], k: int) -> list[tuple[int, int]]:
        """(place, score) of the best ``k`` documents with a score above 0, by falling score and rising place, of (term, weight) pairs."""
        found = [(w, self.lists[t], w * self.best[t]) for t, w in query if t in self.lists and w > 0]
        if not found:
            return []
        found.sort(key=lambda x: int(x[2].max()))
        reach = np.append(0, np.cumsum([int(x[2].max()) for x in found]))
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, window, start, n = 1, FIRST_WINDOW, 0, len(self.ids)
        while start < n:
            end = min(n, start + window)
            # Lists before this one cannot bring a document to the threshold together.
            essential = int(np.searchsorted(reach, least, "left"))
            essential = max(essential - 1, 0)
            if essential == len(found):
                break
            total = np.zeros(end - start, np.int64)
            for w, postings, _ in found[essential:]:
                a, b = np.searchsorted(postings.ends, [start, end - 1])
                b = min(b + 1, len(postings.ends))
                if a < b:
                    p, tf = postings.blocks(np.arange(a, b))
                    s, e = np.searchsorted(p, [start, end])
                    total[p[s:e] - start] += w * self.impact(tf[s:e], self.m[p[s:e]])
            at = np.flatnonzero(total)
            total, at = total[at], at + start
            for i in range(essential - 1, -1, -1):
                w, postings, bound = found[i]
                alive = total + reach[i + 1] >= least
                total, at = total[alive], at[alive]
                if not len(at):
                    break
                block = np.searchsorted(postings.ends, at)
                within = block < len(postings.ends)
                within[within] &= postings.cuts[block[within], 0] <= at[within]
                # The block's own maximum, and what the weaker lists may add.
                alive = total + np.where(within, bound[np.minimum(block, len(bound) - 1)], 0) + reach[i] >= least
                total, at, block, within = total[alive], at[alive], block[alive], within[alive]
                asked = np.flatnonzero(within)
                if len(asked):
                    p, tf = postings.blocks(np.unique(block[asked]))
                    slot = np.minimum(np.searchsorted(p, at[asked]), len(p) - 1)
                    hit = p[slot] == at[asked]
                    got = asked[hit]
                    total[got] += w * self.impact(tf[slot[hit]], self.m[at[got]])
            good = total >= least
            places, scores = np.concatenate([places, at[good]]), np.concatenate([scores, total[good]])
            if len(places) > k:
                keep = np.lexsort((places, -scores))[:k]
                places, scores = places[keep], scores[keep]
            if len(places) == k:
                # Later places lose ties: they must beat the k-th score.
                least = int(scores.min()) + 1
            start, window = end, min(LAST_WINDOW, 2 * window)
        order = np.lexsort((places, -scores))
        return list(zip(places[order].tolist(), scores[order].tolist()))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): terms of each item; rows that repeat id and text are one item."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                at, to, bounds = term_spans(data, offsets, _SEPARATOR)
                of = np.repeat(np.arange(last - first), np.diff(bounds))
                t = pa.table([pa.array(of), term_strings(data, at, to).cast(pa.string())], ["of", "term"]).group_by(["of", "term"]).aggregate([("of", "count")])
                rows = t.column("of").combine_chunks()
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, last - first).take(rows) for c in ("item", "item_id")] + [t.column("term").combine_chunks(), t.column("of_count").combine_chunks()], ["item", "item_id", "term", "times"])

    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    return own.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(run, "item long, item_id long, term string, times long")


def search(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0 (all, if fewer), ties by rising id (null last).

    Statistics are those of the whole index. Items without terms, or whose terms no document holds, give no
    row; so does an empty index. Documents that repeat an id each take a rank; items that repeat an id with
    another text are ranked apart under it. Each group of ``ITEMS`` items meets each shard: an item's terms are copied once a shard.
    """
    own = index.where("term is null")
    totals = own.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("l")).first()
    n, total = totals["n"], totals["l"]
    wanted = settled(query_terms(items, item_col, text_col), "terms")
    kinds = wanted.select("term").distinct()
    lists = index.where("term is not null").join(kinds, "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(df, "term").select("item", "item_id", F.struct("term", (F.col("times") * weight).alias("w")).alias("t"))
    asked = weighed.groupBy("item", "item_id").agg(F.sort_array(F.collect_list("t")).alias("query"))
    count = asked.count()
    groups = max(1, -(-count // ITEMS))
    asked = settled(asked.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")), "asked")
    # One row a shard and group, its items in one array (their number is bounded); each salt meets a bounded number of shards.
    shards = own.select(F.col("shard").alias("s"))
    salts = max(1, -(-own.count() // 64))
    bundles = asked.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("item", "item_id", "query"))).alias("items")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = shards.select("s", F.pmod(F.xxhash64("s"), F.lit(salts)).cast("int").alias("salt")).join(bundles, "salt").select("s", F.col("grp").alias("g"), "items")
    cells = own.select("shard", "term", "ends", "peaks", "cuts", "data").unionByName(lists.select("shard", "term", "ends", "peaks", "cuts", "data"))
    cells = cells.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids = sizes = None
        lists = {}
        for term, *parts in zip(*(rows.column(c).to_pylist() for c in ("term", "ends", "peaks", "cuts", "data"))):
            if term is None:
                ids, sizes = (np.frombuffer(x, np.int64) for x in parts[:2])
            else:
                lists[term] = _List(*parts)
        out = ([], [], [], [])
        if ids is not None and len(queries):
            shard = Searcher(ids, sizes, lists, n, total)
            for q in queries.column("items").to_pylist()[0]:
                for place, score in shard.top([(t["term"], t["w"]) for t in q["query"]], k):
                    doc = int(ids[place])
                    for column, value in zip(out, (q["item"], q["item_id"], None if doc == np.iinfo(np.int64).max else doc, score)):
                        column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["item", "item_id", "doc", "score"])

    found = left.groupBy("s", "g").cogroup(cells.groupBy("shard", "grp")).applyInArrow(run, "item long, item_id long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").isNull(), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


#: The same in DuckDB's SQL.
ORACLE = r"""
with lower_docs as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
lens as (select doc_id, len(t)::bigint as n from lower_docs where len(t) > 0),
stat as (select count(*)::bigint as docs, sum(n)::bigint as terms from lens),
items as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
asked as (select item_id, term, count(*)::bigint as times from items group by all),
posts as (
  select doc_id, term, count(*)::bigint as tf
  from (select doc_id, unnest(t) as term from lower_docs) where term in (select term from asked) group by all),
dfs as (select term, floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1)))::bigint as w from posts, stat group by term, docs),
scored as (
  select a.item_id, p.doc_id, sum(a.times * d.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * l.n * stat.docs) // stat.terms))))::bigint as score
  from asked a join posts p on a.term = p.term join dfs d on d.term = a.term join lens l on l.doc_id = p.doc_id, stat
  group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 20
"""
