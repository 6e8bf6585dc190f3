"""Operator 2: byte-level BPE encoding and decoding.

Encoding never replays merges. Of each pre-token, an Aho-Corasick automaton over
all tokens gives the longest token at every place; the encoder takes it if it
may stand after the token before it, else the next shorter token with the
same start, and steps back when none is left. Two tokens may stand together when
no merge across their border would come before the merges inside them; that is
answered once for each pair and kept in a table. The first sequence whose
neighbours are all compatible is the one that the merges give. Places that were
found to lead nowhere are marked, so that the work is linear in the length. All pre-tokens of a slice of texts are found, told apart and
looked up together in numpy; each kind is encoded once for each Python worker.

Decoding gathers bytes by an offset table over one byte string of all tokens.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import mix, span_hashes, text_slices

#: Distinct pre-tokens that a Python worker remembers.
MEMO = 600_000
#: Pairs of tokens whose compatibility it remembers.
PAIRS = 300_000
#: Bytes of text that are encoded at a time: their code points, hashes and pieces take a hundred times as much.
SLICE = 1 << 19


def _byte_letters() -> dict[str, int]:
    """Printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    first = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    out = np.array([{"L": _LETTER, "N": _NUMBER}.get(k, _OTHER) for k in first], np.uint8)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def piece_starts(cp: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points ``cp``, of documents that begin at ``docs`` (the end comes last).

    Pre-tokens are contractions ('s 't 're 've 'm 'll 'd); runs of letters, of numbers or of other
    signs, each with one space before it; and white space, whose last character stands alone (or
    with the run after it, if it is a space) unless the document ends there.
    """
    n = len(cp)
    kind = _classes()[cp]
    start = np.zeros(n + 1, bool)
    start[docs] = True
    after = np.append(kind[1:], _END)
    after[docs[1:][docs[1:] > 0] - 1] = _END
    start[1:n] |= kind[1:] != kind[:-1]
    last_space = (kind == _SPACE) & (after != _SPACE) & (after != _END)
    start[:n] |= last_space
    start[1:][last_space & (cp == 0x20)] = False
    q = np.flatnonzero(cp == 0x27)
    q = q[start[q] & (after[q] == _LETTER)]
    if len(q):
        one, two = cp[q + 1], cp[np.minimum(q + 2, n - 1)]
        inside = after[np.minimum(q + 1, n - 1)] == _LETTER
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        size = np.where(is_(one, "stmd"), 1, np.where(inside & ((is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))), 2, 0))
        q, size = q[size > 0], size[size > 0]
        start[q + 1] = False
        start[q + 1 + size] = True
    return np.flatnonzero(start[:n])


class Tokens:
    """The bytes of each token of a byte-level BPE vocabulary, by an offset table: all that decoding needs."""

    def __init__(self, spec: str):
        self._load(json.loads(spec))

    def _load(self, model: dict) -> dict[bytes, int]:
        byte_of = _byte_letters()
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        raw = lambda token: bytes(byte_of[c] for c in token)
        ids = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        n = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * n
        for t, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = t
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        return ids

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the token sequences ids[bounds[i]:bounds[i + 1]], end to end, and their offsets."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.blob[at], ends[bounds]

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        data, ends = self.decode_many(ids, bounds)
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def exact(self, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each token sequence decodes to the bytes data[offsets[i]:offsets[i + 1]]."""
        back, ends = self.decode_many(ids, bounds)
        if np.array_equal(ends, offsets) and np.array_equal(back, data):
            return np.ones(len(offsets) - 1, bool)
        spans = zip(ends[:-1].tolist(), ends[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist())
        return np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in spans], bool)


class Bpe(Tokens):
    """Tables for encoding, too."""

    def __init__(self, spec: str):
        import ahocorasick

        model = json.loads(spec)
        ids = self._load(model)
        byte_of, n = _byte_letters(), len(self.bytes_of)
        raw = lambda token: bytes(byte_of[c] for c in token)
        # Each merged token: its rank and halves. A single byte has none.
        self.rank, self.halves, self.merged = [-1] * n, [None] * n, {}
        for r, pair in enumerate(model["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            whole = ids[a + b]
            self.merged[ids[a], ids[b]] = r
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = r, (ids[a], ids[b])
        self.shorter = [-1] * n
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if len(t) == 1 or self.rank[i] >= 0:
                self.automaton.add_word(t.decode("latin-1"), (len(t), i))
                self.shorter[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # by left id * vocabulary size + right id
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        """The table of pre-tokens seen so far: sorted hashes, and where the tokens of each lie in ``flat``."""
        self.known = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens.

        Undo the merges inside both, the latest first, and look at the two parts
        that touch the border: a merge of these that is due before the one just
        undone would have joined them. Of equal merges, the leftmost comes first.
        """
        a, b, due = left, right, float("inf")
        while True:
            if self.merged.get((a, b), due) < due:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                due, a = ra, self.halves[a][1]
            else:
                due, b = rb + 1, self.halves[b][0]

    def encode_piece(self, piece: str) -> list[int]:
        s = piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1")
        n = len(s)
        longest = [None] * n
        for end, hit in self.automaton.iter(s):
            at = end - hit[0] + 1
            old = longest[at]
            if old is None or hit[0] > old[0]:
                longest[at] = hit
        tokens, pos, token = [], 0, longest[0][1]
        dead = bytearray(n + 1)
        pairs, size = self.pairs, len(self.bytes_of)
        while pos < n:
            end = pos + len(self.bytes_of[token])
            ok = not dead[end]
            if ok and tokens:
                pair = tokens[-1] * size + token
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[pair] = self.compatible(tokens[-1], token)
            if ok:
                tokens.append(token)
                pos = end
                if pos < n:
                    token = longest[pos][1]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits at this place: mark it and shorten the token before it
                dead[pos] = 1
                last = tokens.pop()
                pos -= len(self.bytes_of[last])
                token = self.shorter[last]
        return tokens

    def _remember(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if len(self.known) + len(hashes) > MEMO:
            self._forget()
        found = [self.encode_piece(p) for p in pieces]
        size = np.array([len(x) for x in found], np.int64)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.array([t for x in found for t in x], np.uint32)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes().decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        docs = offsets if len(cp) == len(data) else np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
        begin = piece_starts(cp, docs)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
        end = np.append(begin[1:], len(cp))
        hashes = span_hashes(mix(cp.astype(np.uint64) + np.uint64(1)), begin, end)
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, kinds)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != kinds) if len(self.known) else np.arange(len(kinds))
        if len(new):
            if len(self.known) + len(new) > MEMO:  # begin anew with all of this slice
                self._forget()
                new = np.arange(len(kinds))
            self._remember(kinds[new], [text[begin[i] : end[i]] for i in first[new].tolist()])
            place = np.searchsorted(self.known, kinds)
        size = self.size[place][which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.at[place][which] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, docs)]

    def encode(self, text: str) -> list[int]:
        """Token ids of one whole text, pre-token by pre-token; the plain form of ``encode_many``."""
        out = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                cp = np.frombuffer(part.encode("utf-32-le"), np.uint32)
                cuts = [*piece_starts(cp, np.array([0, len(cp)])).tolist(), len(cp)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    out += self.encode_piece(part[a:b])
        return out

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of UTF-8 texts that lie end to end, and their offsets.

        Pre-tokens are told apart by a 64-bit hash, so each kind is encoded once; the
        tokens' bytes are then compared with the texts, and a difference (two kinds
        of one hash) or a special token's string sends the slice the plain way.
        """
        raw = data.tobytes()
        if not any(t.encode() in raw for t in self.special):
            try:
                ids, bounds = self._encode_plain(data, offsets)
                if np.array_equal(self.decode_many(ids, bounds[[0, -1]])[0], data):
                    return ids, bounds
            except UnicodeDecodeError:
                pass
        found = [self.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.array([t for x in found for t in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


_loaded: dict[tuple[type, int], Tokens] = {}


def _tables(kind: type, spec: str) -> Tokens:
    """The worker's tables of a vocabulary, of which it keeps one."""
    key = kind, hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(spec)
    return _loaded[key]


def _spec(df: DataFrame, vocab_path: str):
    """The vocabulary file, sent to the workers once; its size is fixed (a few MB), whatever the data's."""
    with open(vocab_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", n_col: str = "n_tokens", keep: tuple[str, ...] = (), decoded_col: str | None = None, exact_col: str | None = None) -> DataFrame:
    """Token ids of every whole text: columns ``keep``, then n_col (long) and ids_col; with ``decoded_col`` the text that these ids decode to, with ``exact_col`` whether it is the text itself.

    ids_col is binary, four little-endian bytes for each id. Null and empty texts
    give no tokens. A special token's string in a text becomes that token, as the
    vocabulary's library does by default. Rows, repeated ones too, stay as they are;
    other columns are not read. An empty table gives none.
    """
    spec = _spec(df, vocab_path)
    kept = df.select(*keep)
    taken = df.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        bpe = _tables(Bpe, spec.value)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("__text"), SLICE):
                ids, bounds = bpe.encode_many(data, offsets)
                packed = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                columns = [*batch.slice(first, last - first).columns[:-1], pa.array(np.diff(bounds)), packed]
                if decoded_col:
                    columns.append(pa.array(bpe.texts(ids, bounds), pa.string()))
                if exact_col:
                    columns.append(pa.array(bpe.exact(ids, bounds, data, offsets)))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], n_col, ids_col, *[decoded_col] * bool(decoded_col), *[exact_col] * bool(exact_col)])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{n_col}` long", f"`{ids_col}` binary"] + [f"`{decoded_col}` string"] * bool(decoded_col) + [f"`{exact_col}` boolean"] * bool(exact_col)
    return taken.mapInArrow(run, ", ".join(fields))


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts of packed token ids: columns ``keep``, then text_col.

    Bytes that are not UTF-8 become U+FFFD. Null and empty ids give an empty text;
    an id outside the vocabulary fails.
    """
    spec = _spec(df, vocab_path)
    kept = df.select(*keep)
    taken = df.select(*keep, F.col(ids_col).alias("__ids"))

    def run(batches):
        bpe = _tables(Tokens, spec.value)
        for batch in batches:
            packed = [x.as_py() or b"" for x in batch.column("__ids")]
            texts, at = [], 0
            while at < len(packed):  # about a million tokens at a time
                to, size = at, 0
                while to < len(packed) and (to == at or size + len(packed[to]) <= 4_000_000):
                    size += len(packed[to])
                    to += 1
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed[at:to]])]).astype(np.int64)
                texts += bpe.texts(np.frombuffer(b"".join(packed[at:to]), "<u4").astype(np.int64), bounds)
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], text_col])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{text_col}` string"]
    return taken.mapInArrow(run, ", ".join(fields))
