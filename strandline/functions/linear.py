"""Small finalisers in numpy over aggregated rows: normal equations and tail probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR = 252


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, from the front."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_tail(t: float, dof: float) -> float:
    """Two-sided tail probability of Student's t."""
    if dof <= 0 or not math.isfinite(t):
        return 1.0
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_pvalue(df: DataFrame, t: str, dof: Column, name: str) -> DataFrame:
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(x, k) for x, k in zip(t, n)])

    return df.withColumn(name, F.pandas_udf(run, "double")(F.col(t).cast("double"), dof.cast("double")))


def gram(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Sums of all products of (1, xs..., y) for each key, as array ``g`` of the upper triangle: one partial aggregate, whatever the number of rows."""
    cols = [F.lit(1.0), *[F.col(f"`{x}`").cast("double") for x in xs], F.col(y).cast("double")]
    sums = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*keys).agg(F.array(*sums).alias("g"))


def matrix_of(g, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = g
    return m + np.triu(m, 1).T


def attribution(df: DataFrame, key: str, y: str, xs: list[str]) -> DataFrame:
    """Least squares of ``y`` on ``xs`` for each key: (key, factor, beta, tstat, alpha_annualized, alpha_tstat, r_squared, n); too few rows give none."""
    k = len(xs) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, g in zip(batch["key"], batch["g"]):
                m = matrix_of(g, k + 1)
                n = m[0, 0]
                if n <= k:
                    continue
                inv = np.linalg.pinv(m[:k, :k])
                beta = inv @ m[:k, k]
                rss = max(m[k, k] - beta @ m[:k, k], 0.0)
                tss = m[k, k] - m[0, k] ** 2 / n
                se = np.sqrt(np.maximum(rss / (n - k) * np.diag(inv), 0))
                t = np.where(se > 0, beta / np.where(se > 0, se, 1), 0.0)
                rows += [(name, x, round(float(beta[i]), 8), round(float(t[i]), 6), round(float(beta[0] * YEAR), 8), round(float(t[0]), 6), round(float(1 - rss / tss) if tss > 0 else 0.0, 8), int(n)) for i, x in enumerate(xs, 1)]
            yield pd.DataFrame(rows, columns=["key", "factor", "beta", "tstat", "alpha_annualized", "alpha_tstat", "r_squared", "n"])

    g = gram(df, [key], y, xs).withColumnRenamed(key, "key")
    out = g.mapInPandas(run, "key string, factor string, beta double, tstat double, alpha_annualized double, alpha_tstat double, r_squared double, n long")
    return out.withColumnRenamed("key", key)
