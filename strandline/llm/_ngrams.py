"""Hashed byte n-grams of whole texts, and averaged embeddings of them under a linear softmax, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ._words import word_hashes

SIZES = (2, 3, 4)
#: A text's mean is taken over this many neutral n-grams more, so that a few do not decide.
NEUTRAL = 40
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_MULT = np.uint32(0x9E3779B1)


def indices(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n bytes from each place on (texts end to end; the last n - 1 places have none)."""
    x = _FOLD[data].astype(np.uint32)
    h = x[: len(x) - n + 1] + np.uint32(n * 977)
    for k in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * _MULT + x[k : len(x) - n + 1 + k]
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(16))) & np.uint32(buckets - 1)).astype(np.int64)


def repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words of each text equal the word before."""
    words, bounds = word_hashes(data, offsets)
    again = np.zeros(len(words) + 1, np.int64)
    if len(words):
        same = np.append(False, words[1:] == words[:-1])
        same[bounds[:-1][bounds[:-1] < len(words)]] = False
        np.cumsum(same, out=again[1:])
    return again[bounds[1:]] - again[bounds[:-1]]


def counts(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text; no more than ``buckets`` entries, however long the text is."""
    found = [(n, indices(data, n, buckets)) for n in SIZES if len(data) >= n]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        c = np.zeros(buckets, np.int64)
        for n, ix in found:
            if b - a >= n:
                c += np.bincount(ix[a : b - n + 1], minlength=buckets)
        at = np.flatnonzero(c)
        yield at, c[at]


def sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of ``table``'s rows over the n-grams, number of n-grams) of each text."""
    docs = len(offsets) - 1
    total, number = np.zeros((docs, table.shape[1])), np.zeros(docs, np.int64)
    for n in SIZES:
        if len(data) < n:
            continue
        ix = indices(data, n, len(table))
        stop = np.maximum(offsets[:-1], offsets[1:] - n + 1)
        for c in range(table.shape[1]):
            run = np.concatenate([[0.0], np.cumsum(table[ix, c], dtype=np.float64)])
            total[:, c] += run[np.minimum(stop, len(ix))] - run[np.minimum(offsets[:-1], len(ix))]
        number += stop - offsets[:-1]
    return total, number


@dataclass
class Averaged:
    """The fitted model, folded to one row of class scores for each bucket (fixed size: buckets x classes)."""

    classes: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, total: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The classes' scores before the temperature."""
        return total / (number + NEUTRAL)[:, None] + self.bias

    def probabilities(self, total: np.ndarray, number: np.ndarray) -> np.ndarray:
        z = self.logits(total, number) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list, buckets: int, dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 7) -> Averaged:
    """Stochastic gradient descent on one text at a time, with a rate that falls to 0, each class weighing the same."""
    classes = sorted(set(labels))
    y = np.array([classes.index(x) for x in labels])
    draw = np.random.default_rng(seed)
    emb = draw.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out, bias = np.zeros((dim, len(classes))), np.zeros(len(classes))
    weight = len(y) / (len(classes) * np.bincount(y, minlength=len(classes)))
    weight = np.minimum(weight, 5)
    step, steps = 0, max(1, epochs * len(y))
    for _ in range(epochs):
        for i in draw.permutation(len(y)):
            ix, c = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(ix):
                continue
            x = c / (c.sum() + NEUTRAL)
            hidden = x @ emb[ix]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            g *= weight[y[i]] * lr
            back = out @ g
            out -= np.outer(hidden, g)
            bias -= 0.1 * g
            emb[ix] -= np.outer(x, back)
    return Averaged(classes, (emb @ out).astype(np.float32), bias)
