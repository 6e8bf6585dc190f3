"""The standard normal distribution function as a column expression, to double precision.

erfc in three pieces: near 0 the alternating series of erf, between by the integral
representation summed at equal steps, far out the continued fraction, read from the back. No
coefficients are fitted: each piece follows from its formula, and a number of terms that leaves an
error below 1e-15 in its range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Borders of the pieces, terms of the series, step and terms of the sum, depth of the fraction.
SMALL, LARGE = 0.75, 5.0
SERIES, STEP, TERMS, DEPTH = 16, 0.5, 13, 24


def erfc(x: Column) -> Column:
    """The complementary error function of a column of doubles; null stays null, NaN NaN. Sums are folds over literal arrays, so ``x`` is computed once."""
    terms = F.array(*[F.lit((-1) ** k / (math.factorial(k) * (2 * k + 1))) for k in range(SERIES, -1, -1)])
    nodes = F.array(*[F.struct(F.lit(math.exp(-((k * STEP) ** 2)) * (1.0 if k else 0.5)).alias("e"), F.lit((k * STEP) ** 2).alias("s")) for k in range(TERMS)])
    depths = F.array(*[F.lit(k / 2) for k in range(DEPTH, 0, -1)])

    def of(z: Column) -> Column:
        # erf z = 2 / sqrt(pi) * sum of (-1)^k z^(2k+1) / (k! (2k+1)), by Horner's rule.
        near = 1 - F.lit(2 / math.sqrt(math.pi)) * z * F.aggregate(terms, F.lit(0.0), lambda sum_, c: sum_ * z * z + c)
        # The trapezoidal rule for erfc z = 2 z / pi e^(-z^2) * integral of e^(-t^2) / (z^2 + t^2), with its pole's part: exponentially exact.
        total = F.aggregate(nodes, F.lit(0.0), lambda sum_, c: sum_ + c["e"] / (z * z + c["s"]))
        middle = F.lit(2 * STEP / math.pi) * z * F.exp(-z * z) * total - 2 / (F.exp(F.lit(2 * math.pi / STEP) * z) - 1)
        # e^(-z^2) / sqrt(pi) / (z + (1/2) / (z + 1 / (z + (3/2) / ...))).
        far = F.exp(-z * z) / F.lit(math.sqrt(math.pi)) / F.aggregate(depths, z, lambda tail, c: z + c / tail)
        return F.when(z < SMALL, near).when(z < LARGE, middle).otherwise(far)

    return F.transform(F.array(x.cast("double")), lambda v: F.when(v.isNull() | F.isnan(v), v).when(v < 0, 2 - of(-v)).otherwise(of(v)))[0]


def cdf(x: Column) -> Column:
    """The standard normal distribution function."""
    return erfc(-x / math.sqrt(2)) / 2
