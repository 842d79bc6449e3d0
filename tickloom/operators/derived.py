"""Derived values: scaling, labels, mid prices, quality flags, latencies, perpetual and intent views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import asof


def scaled(raw: Column, exponent: Column | int) -> Column:
    """raw * 10^exponent as DECIMAL(38,12)."""
    e = exponent if isinstance(exponent, Column) else F.lit(exponent)
    powers = F.create_map(*(x for k in range(-12, 13) for x in (F.lit(k), F.lit(f"1e{k}").cast("decimal(26,12)"))))
    return (raw.cast("decimal(20,0)") * powers[e.cast("int")]).cast("decimal(38,12)")


def labelled(code: Column, names: dict[int, str], unknown: str = "unknown") -> Column:
    """The name of an enumeration's code; any other code has the unknown label."""
    table = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(table, code.cast("int")), F.lit(unknown))


def provided(value: Column, sentinel: int = 0xFFFF) -> Column:
    """null where the sentinel says that there is no value."""
    return F.nullif(value, F.lit(sentinel))


def modify_target(flags: Column, order_id: Column, client_id: Column) -> tuple[Column, Column]:
    """(target order id, target client id) of a modification: bit 6 of the event flags selects the client id."""
    by_client = flags.bitwiseAND(F.lit(64)) != 0
    return F.when(~by_client, order_id), F.when(by_client, client_id)


def bbo_mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def micro_price(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    """The mid weighted by the other side's size; null without sizes."""
    return F.when(bid_qty + ask_qty > 0, (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty))


def quality_flags(stale: Column, one_sided: Column, crossed: Column, synthetic: Column) -> Column:
    return sum((F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0) for k, c in enumerate((stale, one_sided, crossed, synthetic))), F.lit(0))


def latencies(rows: DataFrame, book: str, compute: str, send: str, received: str) -> DataFrame:
    return rows.withColumns({"compute_lag": F.col(compute) - F.col(book), "send_lag": F.col(send) - F.col(compute), "wire_lag": F.col(received) - F.col(send)})


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregation that is combined before the shuffle, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def forward_filled(rows: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def incomplete_batches(intents: DataFrame, keys: list[str]) -> DataFrame:
    """Batches with fewer distinct indexes than their declared count: keys, batch_count, received."""
    g = intents.groupBy(*keys).agg(F.max("batch_count").alias("batch_count"), F.countDistinct("batch_index").alias("received"))
    return g.where("received < batch_count")


def with_batch_no(rows: DataFrame, keys: list[str], order: list[str], boundary: Column) -> DataFrame:
    """Rows with the number of boundaries before them: rows of equal number become visible together."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("batch_no", F.coalesce(F.sum(boundary.cast("bigint")).over(w), F.lit(0)))


def bandwidth(rows: DataFrame, by: list[str], ts: str, span: int, size: Column) -> DataFrame:
    """Bytes and messages per window of ``span``."""
    slot = F.floor(F.col(ts) / span).cast("bigint").alias("slot")
    return rows.groupBy(*by, slot).agg(F.sum(size).alias("bytes"), F.count("*").alias("messages"))


def mid_or_trade(quotes: DataFrame, trades: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """``quotes`` with mid, where it is null the price of the last trade at or before, and its origin (quotes, trade)."""
    out = asof(quotes, trades.select(*keys, pos, F.col("price").alias("__last")), keys, pos, ["__last"])
    origin = F.when(F.col("mid").isNotNull(), "quotes").when(F.col("__last").isNotNull(), "trade")
    return out.withColumn("origin", origin).withColumn("mid", F.coalesce("mid", "__last")).drop("__last")
