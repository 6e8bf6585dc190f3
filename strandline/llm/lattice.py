"""Operator 13: language-model scoring by the likelihood of a subword lattice.

The lattice of a word holds every segmentation into the pieces of an existing vocabulary
and single bytes: the log-space forward recursion sums the products of piece
probabilities over all of them. Piece probabilities start from the vocabulary's own
scores and are adapted to the training words of each class (the most frequent
languages) by expected counts: forward and backward sums over the lattices of all words, each
kind of word once, as words that are new resemble rare ones. Pieces that begin a word and other pieces share one distribution, so
the probabilities of all words add up to 1.

On it stand two levels of absolute discounting: what the discounts of all training
counts free goes to the lattice, what those of a class free goes to that. A text ends
after each word with the same probability; its words are drawn from a distribution of
its own around the class's (a Polya urn: of each word's repeats only the number counts).
The text's log10 probability is the marginal over segmentations, classes and
concentrations of the urn (``URNS``), all in log space.

Counts never go to the driver but for the most frequent words, bounded in number and
bytes (``HEAD_WORDS``, ``HEAD_BYTES``): these are looked up where the texts lie, so no
frequent word is shuffled by key. All other words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._terms import term_spans, term_strings
from ._words import _IS_SEP, mix, text_slices
from ._work import settled

#: Bounds of what tasks hold of the training counts: words, and bytes of these words.
HEAD_WORDS, HEAD_BYTES = 1 << 18, 8 << 20
#: Rounds of expected counts, and the weight of the vocabulary's own scores against them.
ROUNDS, PRIOR = 2, 100.0
#: Classes with counts of their own: the languages of most training documents. All other documents count in the whole alone.
CLASSES = 8
#: Concentrations of a text's own distribution, equally likely beforehand.
URNS = (100.0, 1000.0, 10000.0)
#: Fixed point of the sums that meet by row: whole numbers add up alike in any order, and small ones pack well.
POINT, BASE_POINT = 1 << 24, 1 << 30
#: Rows of (class, word, count) that a task holds before it passes them on.
HELD_ROWS = 1_000_000
#: Bytes of words whose arcs are in memory at a time.
LATTICE_BYTES = 1 << 18

_SPACE = 0x20
_FOLD = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Pieces:
    """Piece byte strings, 256 single bytes first, and their log probabilities. A piece that begins a word starts with a space."""

    items: tuple[bytes, ...]
    logp: np.ndarray


@lru_cache(4)
def vocabulary(path: str) -> Pieces:
    """Pieces of a sentencepiece file, whose scores are log probabilities (unigram) or negative ranks (merges; then 1 / rank decides)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k):
            continue
        text = model.id_to_piece(k)
        piece = (" " + text[1:] if text.startswith("▁") else text).encode()
        if b"\xe2\x96\x81" not in piece and b" " not in piece[1:] and not any(_IS_SEP[c] for c in piece[1:]) and (len(piece) > 1 or piece == b" "):
            # Only A-Z are folded in texts: pieces with them cannot occur.
            if not any(65 <= c <= 90 for c in piece):
                found[piece] = max(found.get(piece, -np.inf), model.get_score(k))
    scores = np.array(list(found.values()))
    weights = -np.log(10 - scores) if len(scores) and scores.min() < -1000 else scores
    low = weights.min() - np.log(256.0) if len(weights) else 0.0
    items = [bytes([c]) for c in range(256)] + [x for x in found if len(x) > 1]
    logp = np.concatenate([np.full(256, low), [w for x, w in zip(found, weights) if len(x) > 1]])
    logp[_SPACE] = max(low, dict(zip(found, weights)).get(b" ", low))
    return Pieces(tuple(items), logp - np.logaddexp.reduce(logp))


class _Index:
    """Pieces by length and polynomial hash."""

    def __init__(self, items: tuple[bytes, ...]):
        self.by_length = []
        sizes = np.array([len(x) for x in items])
        for n in np.unique(sizes).tolist():
            ids = np.flatnonzero(sizes == n)
            grid = np.frombuffer(b"".join(items[i] for i in ids.tolist()), np.uint8).reshape(len(ids), n)
            h = np.zeros(len(ids), np.uint64)
            for c in range(n):
                h = h * _FOLD + grid[:, c] + np.uint64(1)
            h = mix(h)
            order = np.argsort(h)
            seen = np.zeros(1 << 16, bool)
            seen[(h >> np.uint64(48)).astype(np.int64)] = True
            self.by_length.append((n, h[order], ids[order].astype(np.int32), seen))


@lru_cache(2)
def _index(items: tuple[bytes, ...]) -> _Index:
    return _Index(items)


def _arcs(items: tuple[bytes, ...], data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all arcs, as places in ``data``: words that each begin with a space, from bounds[i] to bounds[i + 1]."""
    end_of = np.repeat(bounds[1:], np.diff(bounds))
    starts, ends, ids = [], [], []
    h, done = np.zeros(len(data), np.uint64), 0
    room = end_of - np.arange(len(data))
    at = np.arange(len(data))
    for n, hashes, found, seen in _index(items).by_length:
        for c in range(done, n):
            at = at[room[at] > c]
            h[at] = h[at] * _FOLD + data[at + c] + np.uint64(1)
        done = n
        x = mix(h[at])
        maybe = np.flatnonzero(seen[(x >> np.uint64(48)).astype(np.int64)])
        x = x[maybe]
        slot = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
        hit = hashes[slot] == x
        starts.append(at[maybe[hit]])
        ends.append(starts[-1] + n)
        ids.append(found[slot[hit]])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)


def _log_sums(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, log of the sum of exp) over runs of equal keys."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    if len(first) == len(keys):
        return keys, values
    top = np.maximum.reduceat(values, first)
    rep = np.repeat(top, np.diff(np.append(first, len(keys))))
    return keys[first], top + np.log(np.add.reduceat(np.exp(values - rep), first))


def _forward(logp: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, rank: np.ndarray, node: np.ndarray, total: int, backward: bool = False) -> np.ndarray:
    """Log sums over all ways to each node (from it to the word's end, if ``backward``)."""
    at, to = (end, start) if backward else (start, end)
    key = -rank[to] if backward else rank[to]
    order = np.lexsort((to, key))
    at, to, weight, key = at[order], to[order], logp[piece[order]], key[order]
    out = np.full(total, -np.inf)
    out[node] = 0.0
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        k, v = _log_sums(out[at[a:b]] + weight[a:b], to[a:b])
        out[k] = v
    return out


def _nodes(data: np.ndarray, bounds: np.ndarray, arcs: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Arcs between nodes (a word of n bytes has n + 1), each node's place in its word, first and last nodes."""
    words = len(bounds) - 1
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(words), sizes)
    start, end, piece = arcs
    rank = np.arange(len(data) + words) - np.repeat(bounds[:-1] + np.arange(words), sizes + 1)
    return start + of[start], end + of[start], piece, rank, bounds[:-1] + np.arange(words), bounds[1:] + np.arange(words)


def word_slices(words: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, after last, bytes, bounds) of words in bounded slices, a space before each word."""
    words = words.cast(pa.large_binary())
    sizes = np.asarray(pc.fill_null(pc.binary_length(words), 0)).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    first = 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LATTICE_BYTES, "right")))
        part = words.slice(first, last - first)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + last - first + 1]
        raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        data = np.insert(raw, offsets[:-1] - offsets[0], _SPACE) if last - first else raw
        yield first, last, data, np.append(0, np.cumsum(sizes[first:last] + 1))
        first = last


def word_logs(items: tuple[bytes, ...], logp: np.ndarray, words: pa.Array) -> np.ndarray:
    """Natural log of each word's lattice probability [classes, words], by the piece probabilities of each class."""
    out = np.zeros((len(logp), len(words)))
    for first, last, data, bounds in word_slices(words):
        start, end, piece, rank, head, tail = _nodes(data, bounds, _arcs(items, data, bounds))
        for z, own in enumerate(logp):
            out[z, first:last] = _forward(own, start, end, piece, rank, head, len(rank))[tail]
    return out


def expected_counts(items: tuple[bytes, ...], logp: np.ndarray, words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Expected number of each piece in the words, each counted so often, over all segmentations."""
    out = np.zeros(len(items))
    for first, last, data, bounds in word_slices(words):
        start, end, piece, rank, head, tail = _nodes(data, bounds, _arcs(items, data, bounds))
        a = _forward(logp, start, end, piece, rank, head, len(rank))
        b = _forward(logp, start, end, piece, rank, tail, len(rank), backward=True)
        of = np.repeat(np.arange(last - first), np.diff(bounds) + 1)[start]
        share = np.exp(a[start] + logp[piece] + b[end] - a[tail][of]) * counts[first:last][of]
        out += np.bincount(piece, weights=share, minlength=len(out))
    return out


@dataclass(frozen=True)
class Model:
    """What tasks need to score words: all of it bounded by parameters, not by the corpus."""

    items: tuple[bytes, ...]
    logp: np.ndarray  # [classes, pieces]: the whole first, then each class
    names: tuple[str, ...]
    discount: np.ndarray  # [classes]
    tokens: np.ndarray  # [classes]: words in training
    kinds: np.ndarray  # [classes]: distinct words in training
    prior: np.ndarray  # [classes]: log probability of each class
    documents: int
    head: pa.Array
    head_counts: np.ndarray  # [classes, head words]
    urns: tuple[float, ...] = URNS

    def total(self) -> int:
        """Training tokens, an end for each document."""
        return int(self.tokens[0]) + self.documents

    def word_logs(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability among words in each class, from its training counts [classes, words]."""
        low = np.exp(word_logs(self.items, self.logp, words))
        n, d, v = self.tokens[:, None], self.discount[:, None], self.kinds[:, None]
        held = np.where(n > 0, np.maximum(counts - d, 0) / np.maximum(n, 1), 0.0)
        free = np.where(n > 0, d * v / np.maximum(n, 1), 1.0)
        whole = held[0] + free[0] * low
        with np.errstate(divide="ignore"):
            p = np.log(np.where(np.arange(len(n))[:, None] == 0, whole, held + free * whole))
        # A long word's lattice may be below the least double: its log is still known.
        lost = ~np.isfinite(p)
        if lost.any():
            logs = word_logs(self.items, self.logp, words) + np.log(free[0]) + np.where(np.arange(len(n))[:, None] == 0, 0.0, np.log(free))
            p = np.where(lost, logs, p)
        return p

    def base_log10(self, counts: np.ndarray) -> np.ndarray:
        """log10 of add-one estimates over all training tokens."""
        return np.log10((counts + 1) / (self.total() + int(self.kinds[0]) + (self.documents > 0) + 1))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted up by 8."""
    low = np.log(np.prod([x + j for j in range(8)], axis=0))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_rising(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log of x (x + 1) ... (x + k - 1)."""
    return np.where(k == 1, np.log(x), _log_gamma(x + k) - _log_gamma(x))


def urn_logs(logs: np.ndarray, times: np.ndarray, urns: tuple[float, ...]) -> np.ndarray:
    """[classes * urns, words]: what a word that occurs so many times adds to a text's log probability, without the common divisor."""
    out = np.empty((len(logs), len(urns), len(times)))
    often = np.flatnonzero(times > 1)
    for u, a in enumerate(urns):
        out[:, u] = logs + np.log(a)
        if len(often):
            # Beyond the least double a repeat adds its count alone.
            x = np.maximum(np.exp(out[:, u, often]), 1e-300)
            out[:, u, often] += log_rising(x + 1, times[often] - 1)
    return out.reshape(len(logs) * len(urns), len(times))


def repeat_logs(logs: np.ndarray, times: np.ndarray, urns: tuple[float, ...]) -> np.ndarray:
    """[classes * urns, words]: what ``urn_logs`` holds besides the word's log, the urn's and that of (times - 1)!; near 0 for rare words."""
    out = np.zeros((len(logs), len(urns), len(times)))
    often = np.flatnonzero(times > 1)
    if len(often):
        k = times[often]
        for u, a in enumerate(urns):
            out[:, u, often] = log_rising(np.maximum(np.exp(logs[:, often] + np.log(a)), 1e-300) + 1, k - 1) - _log_gamma(k.astype(float))
    return out.reshape(len(logs) * len(urns), len(times))


def not_held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo ``parts``, is not ``part``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) != part


def _slices(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, after last, distinct words, each word's place among them, bounds of rows)."""
    for first, last, data, offsets in text_slices(column):
        at, to, bounds = term_spans(data, offsets, _IS_SEP)
        coded = term_strings(data, at, to).dictionary_encode()
        yield first, last, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), bounds


def word_counts(df: DataFrame, text_col: str, class_col: str | None, names: tuple[str, ...]) -> DataFrame:
    """(word, c0, c1, ...): occurrences of each word in all rows, and in those of each named class; pre-aggregated in each task."""
    own = F.lit(0)
    for k, name in enumerate(names):
        own = F.when(F.col(class_col) == name, k + 1).otherwise(own) if class_col else own

    def run(batches):
        held, rows = [], 0

        def out(held):
            t = pa.Table.from_batches(held).group_by(["class", "word"]).aggregate([("c", "sum")])
            return t.select(["class", "word", "c_sum"]).rename_columns(["class", "word", "c"]).to_batches()

        for batch in batches:
            kind = batch.column("class").to_numpy()
            for first, last, words, idx, bounds in _slices(batch.column("text")):
                of = np.repeat(kind[first:last], np.diff(bounds)).astype(np.int64)
                key, n = np.unique(of * max(1, len(words)) + idx, return_counts=True)
                held.append(pa.RecordBatch.from_arrays([pa.array((key // max(1, len(words))).astype(np.int32)), words.take(pa.array(key % max(1, len(words)))), pa.array(n)], ["class", "word", "c"]))
                rows += len(key)
                if rows > HELD_ROWS:
                    merged = out(held)
                    rows = sum(len(b) for b in merged)
                    held = merged
                    if rows > HELD_ROWS // 2:
                        yield from held
                        held, rows = [], 0
        if held:
            yield from out(held)

    found = df.select(own.cast("int").alias("class"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "class int, word string, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c0"), *[F.sum(F.when(F.col("class") == k + 1, F.col("c")).otherwise(0)).alias(f"c{k + 1}") for k in range(len(names))])


def _array(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.array([np.asarray(pc.fill_null(batch.column(c), 0)) for c in names], np.float64).reshape(len(names), len(batch))


def _adapted(counts: DataFrame, pieces: Pieces, classes: int) -> np.ndarray:
    """Piece log probabilities [classes, pieces] after ``ROUNDS`` of expected counts. Each task sends one row a piece at most."""
    logp = np.tile(pieces.logp, (classes, 1))
    columns = [f"c{z}" for z in range(classes)]

    for _ in range(ROUNDS):

        def run(batches, logp=logp):
            total = np.zeros((classes, len(pieces.items)))
            for batch in batches:
                c = _array(batch, columns)
                c[0] -= c[1:].sum(axis=0)
                for z in range(classes):
                    some = np.flatnonzero(c[z] > 0)
                    if len(some):
                        total[z] += expected_counts(pieces.items, logp[z], batch.column("word").take(pa.array(some)), np.ones(len(some)))
            z, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[z, piece])], ["z", "piece", "n"])

        found = counts.mapInArrow(run, "z int, piece int, n double").groupBy("z", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros((classes, len(pieces.items)))
        total[found["z"], found["piece"]] = found["n"]
        total[0] = total.sum(axis=0)
        whole = np.exp(pieces.logp) * PRIOR + total[0]
        whole /= whole.sum()
        total[1:] += PRIOR * whole
        total[0] = whole
        logp = np.log(total / total.sum(axis=1, keepdims=True))
    return logp


def train(df: DataFrame, vocab: str, text_col: str = "text", class_col: str | None = "lang", classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """A model of all rows of ``df``, and the table of all its counts (word, c0, c1, ...).

    Counts and expected counts are of all rows. A null text is a text without words. To
    the driver come statistics of the counts, one row a class and piece, and the head: the
    most frequent words, as many as fit into ``HEAD_WORDS`` and ``HEAD_BYTES``.
    Without rows there are no counts, and the lattice decides alone.
    """
    names, documents, prior = (), df.count(), []
    if class_col:
        top = df.where(F.col(class_col).isNotNull()).groupBy(F.col(class_col).cast("string").alias("k")).count().orderBy(F.desc("count"), "k").limit(classes).collect()
        names, prior = tuple(r["k"] for r in top), [r["count"] for r in top]
    counts = settled(word_counts(df, text_col, class_col, names), "counts")
    kinds = [f"c{z}" for z in range(len(names) + 1)]
    stats = counts.agg(*[f(c).alias(f"{n}{c}") for c in kinds for n, f in (("n", lambda c: F.coalesce(F.sum(c), F.lit(0))), ("v", lambda c: F.count_if(F.col(c) > 0)), ("a", lambda c: F.count_if(F.col(c) == 1)), ("b", lambda c: F.count_if(F.col(c) == 2)))]).first()
    tokens, v = np.array([stats[f"n{c}"] for c in kinds], float), np.array([stats[f"v{c}"] for c in kinds], float)
    once, twice = (np.array([stats[f"{n}{c}"] for c in kinds], float) for n in "ab")
    discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.95)
    pieces = vocabulary(vocab)
    logp = _adapted(counts, pieces, len(kinds))
    shares = np.log(np.array([documents - sum(prior), *prior], float) + 1)
    # The least count whose words all fit into the head.
    step = F.floor(F.log2("c0") * 16).cast("int")
    least, words, size = None, 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("s")).orderBy(F.desc("step")).collect():
        words, size = words + r["n"], size + r["s"]
        if words > HEAD_WORDS or size > HEAD_BYTES:
            break
        least = r["step"]
    head = counts.where(step >= least if least is not None else F.lit(False)).toArrow().combine_chunks()
    held = head.column("word").combine_chunks().cast(pa.large_string())
    model = Model(pieces.items, logp, names, discount, tokens, v, shares - np.logaddexp.reduce(shares), documents, held, np.array([head.column(c).to_numpy() for c in kinds], float).reshape(len(kinds), len(held)))
    return model, counts


def score(df: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and (n_tokens, n_known, train_tokens, base_score, score) of every row of ``df``, in log10.

    Whole texts are scored; null, empty and blank ones have their end alone. Repeated rows
    are scored alike; an empty table gives none. Columns that are not in ``keep`` may have any name.
    """
    kinds, sums = [f"c{z}" for z in range(len(model.tokens))], [f"s{i}" for i in range(len(model.tokens) * len(model.urns))]
    spark = df.sparkSession
    bound = spark.sparkContext.broadcast((model, model.word_logs(model.head, model.head_counts), model.base_log10(model.head_counts[0])))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        m, logs, base = bound.value
        for batch in batches:
            for first, last, words, idx, bounds in _slices(batch.column("text")):
                n, size = last - first, max(1, len(words))
                head = pc.fill_null(pc.index_in(words, value_set=m.head), -1).to_numpy(zero_copy_only=False)
                key, times = np.unique(np.repeat(np.arange(n), np.diff(bounds)) * size + idx, return_counts=True)
                doc, word = key // size, head[key % size]
                here = word >= 0
                total = lambda x: np.bincount(doc[here], weights=x, minlength=n).astype(float)  # noqa: E731  (of nothing it makes whole numbers)
                add = [total(x) for x in urn_logs(logs[:, word[here]], times[here], m.urns)]
                known, based = total(times[here].astype(float)).astype(np.int64), total(times[here] * base[word[here]])
                rest = np.flatnonzero(~here)
                # Of a rare word all is known here but its log, and what a repeat adds beyond (times - 1)!.
                own = np.bincount(doc[rest], minlength=n)
                repeats = np.bincount(doc[rest], weights=np.where(times[rest] > 1, _log_gamma(times[rest].astype(float)), 0.0), minlength=n).astype(float)
                add = [x + repeats + own * np.log(m.urns[i % len(m.urns)]) for i, x in enumerate(add)]
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[rest], np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([words.take(pa.array(key[rest] % size)).cast(pa.string()), pa.array(times[rest])], ["word", "times"]))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), *[batch.column(f"k{i}").slice(first, n) for i in range(len(keep))], pa.array(np.diff(bounds).astype(np.int64)), pa.array(known), pa.array(based), *map(pa.array, add), tail], ["row", *[f"k{i}" for i in range(len(keep))], "n", "known", "base", *sums, "tail"])
                row += n

    kept = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    texts = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    rows = settled(texts.mapInArrow(run, f"row long, {kept}, n long, known long, base double, {', '.join(f'{c} double' for c in sums)}, tail array<struct<word:string,times:long>>"), "scored")

    def rare(batches):
        m = bound.value[0]
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            idx, first = coded.indices.to_numpy(zero_copy_only=False), np.zeros(len(coded.dictionary), np.int64)
            first[idx[::-1]] = np.arange(len(idx))[::-1]
            c = _array(batch, kinds)
            times = batch.column("times").to_numpy()
            logs = m.word_logs(coded.dictionary, c[:, first])[:, idx]
            fixed = lambda x, point=POINT: pa.array(np.rint(x * point).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.where(c[0] > 0, times, 0)), fixed(times * m.base_log10(c[0]), BASE_POINT), *map(fixed, logs), *map(fixed, repeat_logs(logs, times, m.urns))], ["row", "known", "base", *words, *sums])

    words = [f"w{z}" for z in range(len(model.tokens))]
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times").join(counts, "word", "left")
    added = tail.mapInArrow(rare, f"row long, known long, base long, {', '.join(f'{c} long' for c in (*words, *sums))}").groupBy("row").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"t_{c}") for c in ("known", "base", *words, *sums)])
    both = rows.drop("tail").join(added, "row", "left")
    n, total = F.col("n").cast("double"), model.total()
    # Each token is the end with the probability that training tokens are; a text's own distribution divides by u (u + 1) ... (u + n - 1).
    ends = max(model.documents, 0.5) / max(total, 1)
    divisors = urn_divisors(model.urns)
    rare_logs = lambda z, i: F.coalesce(F.col(f"t_w{z}") + F.col(f"t_s{i}"), F.lit(0)) / POINT
    ways = [F.lit(float(model.prior[z] - np.log(len(model.urns)))) + F.col(f"s{i}") + rare_logs(z, i) - divisors[i % len(model.urns)](n) for i in range(len(sums)) for z in [i // len(model.urns)]]
    best = F.greatest(*ways) if len(ways) > 1 else ways[0]
    text = best + F.log(sum((F.exp(w - best) for w in ways[1:]), F.exp(ways[0] - best)))
    end_base, end_known = float(model.base_log10(np.array([float(model.documents)]))[0]), int(model.documents > 0)
    return both.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], (F.col("n") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("t_known", F.lit(0)) + end_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.coalesce("t_base", F.lit(0)) / BASE_POINT + end_base, 6).alias("base_score"),
        F.round((text + F.lit(float(np.log(ends))) + n * float(np.log1p(-min(ends, 0.5)))) / float(np.log(10)), 6).alias("score"),
    )


def urn_divisors(urns: tuple[float, ...]):
    """log of u (u + 1) ... (u + n - 1) as functions of a column n, for each u of 100 or so and more, by Stirling's series."""

    def gamma(x):
        return (x - 0.5) * F.log(x) - x + 1 / (12 * x) - 1 / (360 * x * x * x)

    return [lambda n, u=u: gamma(n + u) - gamma(F.lit(u)) for u in urns]
