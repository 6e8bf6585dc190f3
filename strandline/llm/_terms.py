"""Terms of whole Arrow text buffers: spans between separator bytes, as arrays of their strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, bounds): maximal runs of bytes that are no ``separator``, and each document's first and last run among them."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    at = np.flatnonzero(begins)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def term_strings(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> pa.Array:
    """The spans as strings, A-Z in lower case."""
    if not len(at):
        return pa.array([], pa.large_string())
    cuts = np.empty(2 * len(at), np.int64)
    cuts[0::2], cuts[1::2] = at, to
    # Spans and the gaps between them lie end to end: every second one is a term.
    every = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(LOWER[data])])
    return every.take(pa.array(np.arange(0, len(cuts) - 1, 2)))
