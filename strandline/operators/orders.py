"""Order intents, reconciliation and submission outcomes over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks


def position_deltas(target: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("account", "symbol")) -> DataFrame:
    """Target minus held quantity, for symbols in the target only: what is held beside it is not sold here."""
    return paired_deltas(target.withColumnRenamed("qty", "target").join(held.withColumnRenamed("qty", "held"), list(keys), "left"), keys)


def paired(lines: DataFrame, target: Column, held: Column, keys: tuple[str, ...] = ("account", "symbol")) -> DataFrame:
    """(keys, target, held): summed quantities of the lines of each side in one aggregation, null for a side without lines. Null keys equal none, so there the sides stay apart."""
    apart = F.when(F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True), target)
    return lines.groupBy(*keys, apart.alias("__apart")).agg(F.sum(F.when(target, F.col("qty"))).alias("target"), F.sum(F.when(held, F.col("qty"))).alias("held")).drop("__apart")


def paired_deltas(pairs: DataFrame, keys: tuple[str, ...] = ("account", "symbol")) -> DataFrame:
    """``position_deltas`` of rows with both sides."""
    return pairs.select(*keys, (F.col("target") - F.coalesce("held", F.lit(0))).alias("delta")).where("delta <> 0")


def paired_gaps(pairs: DataFrame) -> DataFrame:
    """``recon_positions`` of rows with both sides."""
    return _gaps(pairs.withColumnsRenamed({"target": "i", "held": "k"}), F.col("symbol"), "position", 2, 0)


def intents(deltas: DataFrame, prices: DataFrame, session: str, version: str, prefix: str, environment: str = "paper", minimum: float = 500.0) -> DataFrame:
    """Orders of at least ``minimum`` notional (a missing price counts as 0) with ids that follow from their content."""
    x = deltas.join(prices, "symbol", "left").where(F.abs(F.col("delta")) * F.coalesce("price", F.lit(0.0)) >= minimum)
    x = x.select("account", "symbol", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").cast("long").alias("qty"), "price")
    body = F.to_json(F.struct("account", F.lit(environment).alias("environment"), "qty", F.lit(session).alias("session"), "side", "symbol", F.lit(version).alias("version")))
    return x.withColumn("client_order_id", F.concat(F.lit(f"{prefix}-{session.replace('-', '')}-"), F.substring(F.sha2(body.cast("binary"), 256), 1, 24)))


def implied_weights(orders: DataFrame, equity: DataFrame) -> DataFrame:
    """(account, signed notional, weight sum, cash weight): equity of 0 or less gives 0."""
    signed = F.when(F.col("side") == "buy", F.col("qty") * F.col("price")).otherwise(-F.col("qty") * F.col("price"))
    x = orders.join(equity, "account").withColumn("n", signed).withColumn("w", F.when(F.col("equity") > 0, F.col("n") / F.col("equity")).otherwise(0.0))
    return x.groupBy("account").agg(F.sum("n").alias("net_notional"), F.sum(F.abs("w")).alias("gross_weight")).withColumn("cash_weight", F.greatest(F.lit(0.0), 1 - F.col("gross_weight")))


def _diffs(a: DataFrame, b: DataFrame, keys: list[str], value: str, kind: str, seq: int, default: object, cast: str = "string") -> DataFrame:
    x = a.withColumnRenamed(value, "i").join(b.withColumnRenamed(value, "k"), keys, "full")
    return _gaps(x, F.col(keys[1]) if len(keys) > 1 else F.lit("cash"), kind, seq, default, cast)


def _gaps(x: DataFrame, item: Column, kind: str, seq: int, default: object, cast: str = "string") -> DataFrame:
    i, k = (F.coalesce(F.col(c), F.lit(default)) for c in ("i", "k"))
    return x.where(i != k).select("account", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), item.alias("item"), i.cast(cast).alias("internal"), k.cast(cast).alias("broker"))


def recon_cash(internal: DataFrame, broker: DataFrame) -> DataFrame:
    return _diffs(internal, broker, ["account"], "cash", "cash", 1, 0)


def recon_positions(internal: DataFrame, broker: DataFrame) -> DataFrame:
    return _diffs(internal, broker, ["account", "symbol"], "qty", "position", 2, 0)


def recon_orders(internal: DataFrame, broker: DataFrame) -> DataFrame:
    """Orders that are open on one side only."""
    both = internal.select("account", "order_id", F.lit(True).alias("i")).unionByName(broker.select("account", "order_id", F.lit(False).alias("i")))
    apart = F.when(F.col("account").isNull() | F.col("order_id").isNull(), F.col("i"))  # null keys equal none
    x = both.groupBy("account", "order_id", apart.alias("__apart")).agg(F.bool_or("i").alias("i"), F.bool_or(~F.col("i")).alias("k"))
    shown = lambda c: F.when(F.col(c), "open")
    return _gaps(x.withColumns({"i": shown("i"), "k": shown("k")}), F.col("order_id"), "order", 3, "absent")


def reconciliation(*parts: DataFrame) -> DataFrame:
    """All differences in order (cash, positions, orders; by item), the account blocked if it has any."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("blocked", F.lit(True)).orderBy("account", "seq", "item")


def outcomes(wanted: DataFrame, existing: DataFrame, blocked: Column) -> DataFrame:
    """What a submission would come to: blocked, already_existed, submitted or rejected (by the state that the broker reports)."""
    x = wanted.join(existing.select("client_order_id", F.lit(True).alias("seen")).distinct(), "client_order_id", "left")
    outcome = F.when(blocked, "blocked").when(F.col("seen"), "already_existed").when(F.col("state") == "rejected", "rejected").otherwise("submitted")
    return x.withColumn("outcome", outcome).drop("seen")


def open_orders(orders: DataFrame, state: str = "state") -> DataFrame:
    return orders.where(F.col(state).isin("new", "partially_filled"))


def recent_fills(fills: DataFrame, at: str, *then: str) -> DataFrame:
    """All fills with ``seq``, their place in the order they came in (from 1): by date and, within one, by ``then``."""
    return blocks.numbered(fills, [], at, "seq", then).withColumn("seq", F.col("seq") + 1)


def preview(intents: DataFrame, checks: DataFrame, differences: DataFrame) -> DataFrame:
    """(account, part, seq, item, status, detail, blocked): all that a preview shows of each account that has intents or differences, in long form.

    Parts: its rules (item: code; status: pass or block), its differences (item: kind and item; detail: both sides) and its
    intents (item: symbol; status: side; detail: id). An account is blocked if a rule or a difference blocks it, or if it was never checked.
    """
    rule = checks.select(F.col("proposal_id").alias("account"), F.lit("rule").alias("part"), "seq", F.col("code").alias("item"), "status", "detail")
    gap = differences.select("account", F.lit("difference").alias("part"), "seq", F.concat_ws(" ", "kind", "item").alias("item"), F.lit("block").alias("status"), F.concat_ws(" is not ", "internal", "broker").alias("detail"))
    order = intents.select("account", F.lit("intent").alias("part"), F.lit(1).alias("seq"), F.col("symbol").alias("item"), F.col("side").alias("status"), F.col("client_order_id").alias("detail"))
    gate = rule.unionByName(gap).unionByName(order).groupBy("account").agg(
        F.coalesce(F.bool_or((F.col("part") != "intent") & (F.col("status") == "block")), F.lit(False)).alias("b"), F.count_if(F.col("part") == "rule").alias("r"), F.count_if(F.col("part") != "rule").alias("n")
    )
    gate = gate.where("n > 0").select("account", (F.col("b") | (F.col("r") == 0)).alias("blocked"))
    return rule.unionByName(gap).unionByName(order).join(gate, "account")
