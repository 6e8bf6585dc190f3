"""A report as one nested document for each key, assembled from tables by one keyed aggregation.

Every block becomes rows (key, block, JSON text): an object from a table of one row a key, a list from one of
several. All blocks of all keys then meet in one shuffle. Lists are as long as what they report: thinned curves,
bins, calendar parts, a ranking's first places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JSON = {"ignoreNullFields": "false"}


def _body(df: DataFrame, key: str | None) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key]), _JSON)


def as_object(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, json) of a table with one row a key; without a key, of its only row."""
    return df.select(*([F.col(key).alias("key")] if key else []), _body(df, key).alias("json"))


def as_list(df: DataFrame, order: list[Column], key: str | None = None) -> DataFrame:
    """(key, json) of the rows of each key in order; without a key, of all rows, which have to be few."""
    rows = df.select(*([F.col(key).alias("key")] if key else []), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], _body(df, key).alias("json")).alias("x"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["json"]), ","), F.lit("]"))
    return rows.groupBy(*(["key"] if key else [])).agg(listed.alias("json"))


def assemble(keys: DataFrame, blocks: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, payload): a document for each row of ``keys`` (one column) with the blocks in the order given.

    ``blocks`` are tables (key, json), or (json) of one row, which every document shows. A document without a row in
    a block shows null there; rows of keys that are not asked for are left out.
    """
    asked = keys.select(F.col(key).alias("key")).distinct()
    parts = []
    for i, (name, df) in enumerate(blocks.items()):
        x = df if "key" in df.columns else asked.join(df, F.lit(True))  # one row beside each key
        parts.append(x.select("key", F.lit(i).alias("place"), F.lit(name).alias("name"), "json"))
    rows = reduce(DataFrame.unionByName, parts, asked.select("key", F.lit(-1).alias("place"), F.lit("").alias("name"), F.lit("").alias("json")))
    held = rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("name", "json"))).alias("m"), F.min("place").alias("first")).where("first < 0")
    shown = [F.concat(F.lit(f'"{name}":'), F.coalesce(F.try_element_at("m", F.lit(name)), F.lit("null"))) for name in blocks]
    return held.select(F.col("key").alias(key), F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}")).alias("payload"))
