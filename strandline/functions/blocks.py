"""Running figures and trailing windows over series of any length.

A window over one series is one task's work, however long the series is. Here a series is
cut into ranges of its order, so that most of the work is spread: a running figure is a
window inside each range and what the ranges before it hold in all (two levels, the
upper one of a row a range); a trailing or leading window is taken inside blocks of
equally many rows, into which the neighbours' last and first rows are copied (halo).

Series are told by the columns ``by`` (none: the whole table is one series), null keys
included. ``order`` is a date or a whole number. A range holds at most ``WIDTH`` values of it, so
its rows are bounded where rows of a series are unique in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of the order (days) in a range, rows in a block.
WIDTH, BLOCK = 1024, 2048


def _range(df: DataFrame, order: str, width: int) -> Column:
    """The number of the range of a row; null orders have one of their own before all others."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        value = F.unix_date(order)
    elif isinstance(kind, T.IntegralType):
        value = F.col(order)
    else:
        raise TypeError(f"{order} must be a date or a whole number, not {kind.simpleString()}")
    return F.coalesce(F.floor(value.cast("long") / width), F.lit(-(1 << 62)))


_WITHIN = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, by: list[str], order: str, out: dict[str, tuple[Column, str]], then: tuple[str, ...] = (), descending: bool = False, before: bool = False, width: int = WIDTH) -> DataFrame:
    """``df`` and a column for each entry of ``out``: name -> (value, kind), the figure over all rows of the series up to this one (``before``: but this one).

    Kinds: sum, max, min, and last, the latest value that is not null. Nulls are passed over; without a value the
    figure is null. Rows come in the order of ``order`` (null first) and ``then``; rows that tie in all of them come in any order.
    """
    keys, at = [f"__k{i}" for i in range(len(by))], "__range"
    values = {f"__v{i}": v for i, (v, _) in enumerate(out.values())}
    x = df.withColumns({at: _range(df, order, width), **values})
    row = F.struct(F.col(order).isNotNull(), order, *then)
    ordering = [c.desc() if descending else c.asc() for c in (F.col(order).isNotNull(), F.col(order), *map(F.col, then))]
    total = {}
    for v, (_, kind) in zip(values, out.values()):
        if kind == "last":
            total[v] = (F.min_by if descending else F.max_by)(v, F.when(F.col(v).isNotNull(), row))
        else:
            total[v] = _WITHIN[kind](v)
    upper = x.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(by, keys)], F.col(at).alias("__at")).agg(*[t.alias(f"{v}t") for v, t in total.items()])
    earlier = Window.partitionBy(*keys).orderBy(F.col("__at").desc() if descending else F.col("__at")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*[F.col(f"`{k}`") for k in by], at).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    over = lambda c, kind, w: F.last(c, ignorenulls=True).over(w) if kind == "last" else _WITHIN[kind](c).over(w)
    upper = upper.select(*keys, "__at", *[over(f"{v}t", kind, earlier).alias(f"{v}e") for v, (_, kind) in zip(values, out.values())])
    same = F.col(at) == F.col("__at")
    for k, n in zip(by, keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(n))
    both = x.join(upper, same)
    found = {}
    for name, v, (_, kind) in zip(out, values, out.values()):
        e, i = F.col(f"{v}e"), over(v, kind, inside)
        found[name] = F.coalesce(i, e) if kind == "last" else F.coalesce(e + i, e, i) if kind == "sum" else (F.greatest if kind == "max" else F.least)(e, i)
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in found.items()])


def numbered(df: DataFrame, by: list[str], order: str, name: str, then: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """``df`` with the place of each row in its series, from 0."""
    return running(df, by, order, {name: (F.lit(1).cast("long"), "sum")}, then, width=width).withColumn(name, F.col(name) - 1)


def previous(df: DataFrame, by: list[str], order: str, column: str, name: str, default: Column | None = None, width: int = WIDTH) -> DataFrame:
    """``df`` with the value of ``column`` in the row before, null values included; ``default`` in the first row."""
    x = running(df, by, order, {"__before": (F.struct(F.col(column).alias("x")), "last")}, before=True, width=width)
    value = F.col("__before.x")
    return x.withColumn(name, value if default is None else F.when(F.col("__before").isNull(), default).otherwise(value)).drop("__before")


def haloed(df: DataFrame, by: list[str], order: str, back: int, ahead: int = 0, place: str = "place", size: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """``df`` with ``place``, ``__block`` and ``__own``: each row once for its own block, and again for a neighbour that needs it.

    Windows that reach at most ``back`` rows back and ``ahead`` rows ahead are exact for own rows, if they are partitioned by ``by`` and
    ``__block``. What the halo adds is (back + ahead) / size of the rows.
    """
    if max(back, ahead) > size:
        raise ValueError(f"a block of {size} rows cannot hold a halo of {max(back, ahead)}")
    x = numbered(df, by, order, place, width=width)
    block, inside = F.floor(F.col(place) / size), F.col(place) % size
    copy = lambda b, own: F.struct(b.cast("long").alias("__block"), F.lit(own).alias("__own"))
    places = F.array_compact(F.array(copy(block, True), F.when(inside >= size - back, copy(block + 1, False)), F.when((inside < ahead) & (block > 0), copy(block - 1, False))))
    return x.select("*", F.inline(places))


def windowed(df: DataFrame, by: list[str], order: str, columns, back: int, ahead: int = 0, place: str = "place", size: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """``df`` with ``place`` and the columns that ``columns(window)`` returns, a list of steps of name -> value, each over windows of the series.

    ``window(lo, hi)`` is the frame from lo rows before to hi rows after a row, ``window()`` the plain order for lag and lead.
    """

    def window(lo: int | None = None, hi: int = 0):
        w = Window.partitionBy(*[F.col(f"`{k}`") for k in by], "__block").orderBy(order)
        return w if lo is None else w.rowsBetween(-lo, hi)

    x = haloed(df, by, order, back, ahead, place, size, width)
    for step in columns(window):
        x = x.withColumns(step)
    return x.where("__own").drop("__block", "__own")
