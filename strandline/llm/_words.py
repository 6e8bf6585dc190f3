"""Word and shingle hashing over whole Arrow text buffers, in numpy.

A batch's texts lie end to end in one byte buffer, so words of all documents
are found and hashed together: no per-word Python. Words are maximal runs of
bytes other than space and 0x09-0x0D; A-Z count as a-z. Memory is bounded by
``SLICE_BYTES`` of text at a time (or one document, when that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in slices of about this many bytes, to stay within cache.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after last, bytes, offsets from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    n = len(wide)
    if not n:
        return
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + n + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def span_hashes(values: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Polynomial hashes (modulo 2^64, then mixed with the length) of values[at[i]:to[i]]."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power("up", _MULT, n), out=sums[1:])
    return mix((sums[to] - sums[at]) * _power("down", _INV, n)[at] + (to - at).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return (hash of each word, offsets of each document's words)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(_BYTE_VALUES[data], at, to), np.searchsorted(at, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each document its distinct ``width``-word shingles as sorted int64 hashes.

    A document with fewer words (but one at least) has its whole sequence as its only shingle.
    """
    n = len(words)
    if n >= width:
        h = words[: n - width + 1].copy()
        for k in range(1, width):
            h = mix(h * _MULT + words[k : n - width + 1 + k])
        h = h.view(np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            x = np.sort(h[a : b - width + 1])
            yield x[np.append(True, x[1:] != x[:-1])]
        elif b > a:
            x = words[a].copy()
            with np.errstate(over="ignore"):
                for k in range(a + 1, b):
                    x = mix(x * _MULT + words[k])
                yield mix(np.array([x], np.uint64) + np.uint64(b - a)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
