"""Schema contracts, snapshots and manifests, JSON payloads, evidence and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written  # noqa: F401


def contract(df: DataFrame, wanted: str) -> DataFrame:
    """(column, wanted, found, ok, nulls) of each column of a schema in DDL: its type, and in one pass over the rows how many are null; a missing column has no count and is not ok."""
    need = T.StructType.fromDDL(wanted)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    said = [(f.name, f.dataType.simpleString(), have.get(f.name)) for f in need]
    row = lambda c, w, h: F.struct(F.lit(c).alias("column"), F.lit(w).alias("wanted"), F.lit(h).cast("string").alias("found"), F.lit(w == h).alias("ok"), (F.col(f"n_{c}") if h else F.lit(None).cast("long")).alias("nulls"))
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c, _, h in said if h])
    return counts.select(F.inline(F.array(*[row(*x) for x in said])))


def lookup(table: DataFrame, dataset: str, snapshot_id: str | None = None) -> DataFrame:
    out = table.where((F.col("dataset") == dataset) & F.col("valid"))
    return out if snapshot_id is None else out.where(F.col("snapshot_id") == snapshot_id)


def bars_to_json(bars: DataFrame) -> DataFrame:
    """One payload a session: {"bars": {symbol: [{t, o, h, l, c, v, vw, n}]}, "next_page_token": null}. A session holds a bar for each symbol, no more."""
    s = lambda c: F.col(c).cast("string")
    bar = F.struct(F.concat(s("session"), F.lit("T05:00:00Z")).alias("t"), s("open").alias("o"), s("high").alias("h"), s("low").alias("l"), s("close").alias("c"), F.col("volume").cast("long").alias("v"), s("vwap").alias("vw"), F.col("trade_count").alias("n"))
    return bars.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.array(bar)))).alias("m")).select(F.to_json(F.struct(F.col("m").alias("bars"))).alias("payload"))


def bars_from_json(df: DataFrame, payload: str) -> DataFrame:
    """Typed bars of landed payloads, with the reason where one is not valid; an unreadable payload is one such row."""
    bar = "t string, o string, h string, l string, c string, v bigint, vw string, n bigint"
    x = df.select(F.from_json(payload, f"bars map<string, array<struct<{bar}>>>").alias("p"))
    rows = x.select(F.explode_outer("p.bars").alias("symbol", "list")).select("symbol", F.explode_outer("list").alias("b")).select("symbol", "b.*")
    price = lambda c: F.col(c).try_cast("decimal(18,4)")
    typed = rows.select(
        "symbol", F.to_date(F.to_utc_timestamp(F.try_to_timestamp("t", F.lit("yyyy-MM-dd'T'HH:mm:ssX")), "UTC")).alias("session"), price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"), F.col("v").alias("volume"), price("vw").alias("vwap"), F.col("n").alias("trade_count")
    )
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"bad_{c}")) for c in typed.columns]))
    return typed.withColumn("reason", F.array_join(missing, ","))


# Raw broker states and ours; any other is ``new``.
STATES = {
    "new": "new", "accepted": "new", "pending_new": "new", "accepted_for_bidding": "new", "stopped": "new", "held": "new",
    "partially_filled": "partially_filled", "filled": "filled", "canceled": "rejected", "expired": "rejected", "rejected": "rejected",
    "replaced": "rejected", "pending_cancel": "new", "pending_replace": "new", "done_for_day": "rejected", "suspended": "rejected", "calculated": "filled",
}


def orders_from_json(df: DataFrame, payload: str) -> DataFrame:
    """(order_id, state, qty, filled_qty, submitted_at) of raw order records; missing filled quantities are 0, the case of states does not count."""
    x = df.select(F.from_json(payload, "id string, client_order_id string, symbol string, qty string, filled_qty string, side string, status string, submitted_at string").alias("o")).select("o.*")
    states = F.create_map(*[F.lit(v) for kv in STATES.items() for v in kv])
    whole = lambda c: F.col(c).try_cast("decimal(38,10)").cast("bigint")
    return x.select(F.col("id").alias("order_id"), F.coalesce(F.try_element_at(states, F.lower("status")), F.lit("new")).alias("state"), whole("qty").alias("qty"), F.coalesce(whole("filled_qty"), F.lit(0).cast("bigint")).alias("filled_qty"), F.try_to_timestamp("submitted_at").alias("submitted_at"))


def evidence(df: DataFrame, kind: str, at: str, session: str) -> DataFrame:
    """Append-only evidence rows: (id, kind, decision_session, created_at, payload); the id is the payload's digest, the clock a parameter."""
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select(F.sha2(F.concat_ws("|", F.lit(kind), body).cast("binary"), 256).alias("id"), F.lit(kind).alias("kind"), F.col(session).alias("decision_session"), F.lit(at).cast("timestamp").alias("created_at"), body.alias("payload"))


def reload(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows of evidence payloads."""
    return rows.select(F.from_json("payload", schema).alias("p")).select("p.*")


def fields(rows: DataFrame, payload: str, wanted: dict[str, tuple[str, str]], *keep: str) -> DataFrame:
    """Columns ``keep`` and, for each name, the value at a path of the payload as a type: {name: (path, type)}.

    Each payload is parsed once, to a variant, whatever its shape; no schema is needed. What is missing, not JSON or not of the type is null.
    """
    x = rows.withColumn("__v", F.try_parse_json(payload))
    return x.select(*keep, *[F.try_variant_get("__v", path, kind).alias(name) for name, (path, kind) in wanted.items()])


def keys_of(rows: DataFrame, payload: str) -> DataFrame:
    """(key, kind, n): the top-level keys of all payloads with the kinds of their values, and how often each occurs. What is not a JSON object is passed over."""
    v = rows.select(F.try_parse_json(payload).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    x = v.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return x.groupBy("key", F.lower(F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)).alias("kind")).agg(F.count("*").alias("n"))


def to_insert(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, one for each key: of several the least row, column by column, whatever the order they came in."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, *[F.col("__r")[c].alias(c) for c in rest]) if rest else new.select(key).distinct()
    return first.select(*new.columns).join(stored.select(key).distinct(), key, "left_anti")


def stored_counts(stored: DataFrame, key: str) -> DataFrame:
    """(key, n): how often each key is stored; once, if only ``to_insert`` feeds the table."""
    return stored.groupBy(key).agg(F.count("*").alias("n"))


def run_lines(orders: DataFrame) -> DataFrame:
    """Orders told as run records in JSON lines; every tenth line is cut short."""
    body = F.to_json(F.struct(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.lit("complete").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("finished"), F.struct(F.round(F.col("o_totalprice") / 1e5, 4).alias("sharpe")).alias("metrics")))
    return orders.select(F.when(F.col("o_orderkey") % 10 == 0, F.substring(body, 1, 20)).otherwise(body).alias("value"))


RUN = "run_id string, status string, finished string, metrics struct<sharpe double>, _corrupt string"


def runs_from_text(lines: DataFrame) -> DataFrame:
    """Readable run records, newest first."""
    x = lines.select(F.from_json("value", RUN, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return x.where("_corrupt is null and run_id is not null").select("run_id", "status", F.to_date("finished").alias("finished"), "metrics").orderBy(F.desc("finished"), "run_id")
