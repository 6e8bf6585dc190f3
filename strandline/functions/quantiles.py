"""Exact order statistics and quantiles by distributed selection.

A double's bits, with the sign turned, sort as the number does. Each round counts the rows
that are still in question by the next bits of that key: the counts (one row a series and
prefix, at most 2^``BITS`` of them) tell which prefix holds the wanted place, and only
rows with that prefix stay. After the last round the prefix is the value. What a task holds are
counts of prefixes, never the values of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Bits of a round: sign, exponent and four bits of the mantissa come first.
BITS = 16


def sortable(value: Column) -> Column:
    """A whole number for each double in the order of doubles: -0.0 counts as 0.0, NaN is the greatest."""
    d = F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), d).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def double_of(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(key)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def order_statistics(rows: DataFrame, key: str, value: str, wanted: DataFrame) -> DataFrame:
    """(key, place, value): the value at each place (from 0) of the sorted series, for the pairs (key, place) of ``wanted``; null values are left out.

    Places beyond a series give no row; keys that are null are a series. ``wanted`` may hold any number of places.
    """
    left = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), sortable(F.col(value)).alias("x"))
    sizes = left.groupBy(F.col("k").alias("ck")).agg(F.count("*").alias("size"))
    asked = wanted.select(F.col(key).alias("k"), F.col("place").cast("long").alias("place")).distinct().join(sizes, F.col("k").eqNullSafe(F.col("ck")))
    asked = written(asked.select("k", "place", F.lit(0).cast("long").alias("prefix"), F.col("place").alias("rest"), "size"), "places")
    shift = 64
    while shift:
        # Where no prefix holds more rows than a round has prefixes, one last round reads all bits that are left.
        most = asked.agg(F.max("size")).first()[0] or 0
        upper, shift = shift, 0 if most <= 1 << BITS else shift - BITS
        own = F.shiftright("x", shift)
        above = F.shiftright("x", upper) if upper < 64 else F.lit(0).cast("long")
        if upper < 64:
            # Only rows under a wanted prefix are still in question.
            under = asked.select(F.col("k").alias("wk"), F.col("prefix").alias("wp")).distinct()
            left = left.join(under, F.col("k").eqNullSafe(F.col("wk")) & (above == F.col("wp")), "left_semi")
        counts = left.groupBy("k", above.alias("upper"), own.alias("own")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("k", "upper").orderBy("own").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select(F.col("k").alias("ck"), "upper", "own", "n", F.coalesce(before, F.lit(0)).alias("before"))
        here = F.col("k").eqNullSafe(F.col("ck")) & (F.col("prefix") == F.col("upper"))
        found = asked.join(counts, here).where((F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("n")))
        asked = written(found.select("k", "place", F.col("own").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"), F.col("n").alias("size")), "places")
    return asked.select(F.col("k").alias(key), "place", double_of(F.col("prefix")).alias(value))


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, names...): exact quantiles of each series, linear between neighbours, as ``percentile`` gives them. A series without values has nulls."""
    sizes = written(rows.groupBy(key).agg(F.count(value).alias("n")), "sizes")
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ends = lambda p: [F.floor(at(p)), F.ceil(at(p))]
    places = sizes.where("n > 0").select(key, F.explode(F.array(*[e for p in shares.values() for e in ends(p)])).alias("place"))
    found = order_statistics(rows, key, value, places)
    held = found.groupBy(F.col(key).alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct("place", value))).alias("m"))  # two entries a share
    both = sizes.join(held, F.col(key).eqNullSafe(F.col("__k")), "left")

    def linear(p: float) -> Column:
        lo, hi = ends(p)
        low, high = F.try_element_at("m", lo), F.try_element_at("m", hi)
        return F.when(lo == hi, low).otherwise((hi - at(p)) * low + (at(p) - lo) * high)

    return both.select(key, *[linear(p).alias(n) for n, p in shares.items()])
