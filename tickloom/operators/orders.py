"""Order-level books: lifecycles, references of operations to orders, and quantities.

events: keys, pos, kind (add, cancel, execute), order_id, side, price, qty, source, aggressor, full_fill. One window per
order: the shuffle is on (keys, order_id), which no single instrument can make hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_lifecycle(events: DataFrame, keys: list[str]) -> DataFrame:
    """``events`` with life (adds of the order so far), and of the running life: entry_qty, entry_side, entry_price,
    entry_source, removed (a cancel or full fill before this row) and filled (quantity executed before this row)."""
    # Every column is of one order's rows by position, the running life's being what has come less what had come at its add:
    # one sort, where windows by life would sort the rows once more in the same task.
    order = Window.partitionBy(*keys, "order_id").orderBy("pos")
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    is_add, is_fill = F.col("kind") == "add", F.col("kind") == "execute"
    ends = (F.col("kind") == "cancel") | (is_fill & F.coalesce(F.col("full_fill"), F.lit(False)))
    e = events.withColumn("life", F.sum(is_add.cast("bigint")).over(until))
    come = {"__ended": F.when(ends, 1).otherwise(0), "__fills": F.when(is_fill, F.col("qty")).cast("decimal(20,0)")}
    e = e.withColumns({c: F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in come.items()})
    at_add = lambda c: F.last(F.when(is_add, F.struct(c)), ignorenulls=True).over(until)[c]
    e = e.withColumns({f"entry_{c}": at_add(c) for c in ("qty", "side", "price", "source")} | {f"{c}_then": at_add(c) for c in come})
    since = lambda c: F.col(c) - F.coalesce(f"{c}_then", F.lit(0))
    e = e.withColumns({"removed": since("__ended") > 0, "filled": since("__fills").cast("bigint")})
    return e.drop(*come, *(f"{c}_then" for c in come))


def with_versions(lives: DataFrame, keys: list[str]) -> DataFrame:
    """``lives`` with what ``versions`` needs of an order's other rows: until, first_flags and first_enter_ts (of the life's add).
    Over the sort of ``with_lifecycle``, if it comes right after it."""
    order = Window.partitionBy(*keys, "order_id").orderBy("pos")
    at_add = lambda c: F.last(F.when(F.col("kind") == "add", F.struct(c)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))[c]
    return lives.withColumns({"until": F.lead("per_seq").over(order), "first_flags": at_add("flags"), "first_enter_ts": at_add("enter_ts")})


def overfilled(lives: DataFrame) -> DataFrame:
    """Executions of more than is left of a running life."""
    return lives.where((F.col("kind") == "execute") & (F.col("life") > 0) & ~F.col("removed") & (F.col("qty") > F.col("entry_qty") - F.col("filled")))


def settled(lives: DataFrame, keys: list[str]) -> DataFrame:
    """``lives`` in which an execution of more than is left, and without the full-fill flag, leaves its order as it was.

    What counts as filled then depends on what was let through before, so the orders that have such an execution, and no
    others, are folded."""
    own = [*keys, "order_id", "life"]
    odd = overfilled(lives).select(*own).distinct()
    event = F.struct("pos", (F.col("kind") == "execute").alias("fills"), F.col("qty").cast("bigint").alias("qty"), F.col("entry_qty").cast("bigint").alias("most"))
    kind = lives.schema["pos"].dataType.simpleString()
    start = F.expr(f"named_struct('filled', 0L, 'rows', cast(array() as array<struct<pos:{kind},filled:bigint>>))")

    def step(s: Column, x: Column) -> Column:
        after = s["filled"] + F.when(x["fills"] & (s["filled"] + x["qty"] <= x["most"]), x["qty"]).otherwise(0)
        return F.struct(after.cast("bigint").alias("filled"), F.concat(s["rows"], F.array(F.struct(x["pos"].alias("pos"), s["filled"].alias("filled")))).alias("rows"))

    events = lives.join(odd, own, "left_semi").groupBy(*own).agg(F.array_sort(F.collect_list(event)).alias("all"))
    fixed = events.select(*keys, "order_id", F.explode(F.aggregate("all", start, step, lambda s: s["rows"])).alias("r")).select(*keys, "order_id", "r.pos", F.col("r.filled").alias("__filled"))
    return lives.join(fixed, [*keys, "order_id", "pos"], "left").withColumn("filled", F.coalesce("__filled", "filled")).drop("__filled")


def dangling(lives: DataFrame, kind: str) -> DataFrame:
    """Operations of a kind on orders that were never added."""
    return lives.where((F.col("kind") == kind) & (F.col("life") == 0))


def after_removal(lives: DataFrame) -> DataFrame:
    return lives.where("kind in ('cancel', 'execute') and life > 0 and removed")


def duplicate_adds(lives: DataFrame, keys: list[str]) -> DataFrame:
    """Adds of an order that is live: the life before ended neither by a cancel nor by a full fill."""
    w = Window.partitionBy(*keys, "order_id").orderBy("pos")
    ends = (F.col("kind") == "cancel") | ((F.col("kind") == "execute") & F.coalesce(F.col("full_fill"), F.lit(False)))
    live = ~F.coalesce(F.lag("removed").over(w), F.lit(True)) & ~F.coalesce(F.lag(ends).over(w), F.lit(True))
    return lives.withColumn("was_live", live).where("kind = 'add' and life > 1 and was_live")


def quantities(lives: DataFrame) -> DataFrame:
    """Executions on live orders with remaining, overfill, and disagree: the full-fill flag against the quantity, which
    an overfill masks."""
    e = lives.where("kind = 'execute' and life > 0 and not removed").withColumn("remaining", F.col("entry_qty") - F.col("filled"))
    over = F.col("qty") > F.col("remaining")
    return e.withColumn("overfill", over).withColumn("disagree", ~over & F.coalesce(F.col("full_fill"), F.lit(False)) & (F.col("qty") != F.col("remaining")))


def wrong_side(lives: DataFrame) -> DataFrame:
    """Executions whose aggressor (1 buys, 2 sells) is on the resting order's side (0 bid, 1 ask)."""
    return lives.where("kind = 'execute' and life > 0 and ((aggressor = 1 and entry_side <> 1) or (aggressor = 2 and entry_side <> 0))")


def other_source(lives: DataFrame) -> DataFrame:
    return lives.where("kind <> 'add' and life > 0 and source <> 0 and entry_source <> 0 and source <> entry_source")


def ungrouped_trades(trades: DataFrame, executions: DataFrame, keys: list[str]) -> DataFrame:
    """Trades with an id that no earlier execution carries."""
    first = executions.groupBy(*keys, "trade_id").agg(F.min("pos").alias("first_pos"))
    return trades.where("trade_id <> 0").join(first, [*keys, "trade_id"], "left").where("first_pos is null or first_pos >= pos").drop("first_pos")


def live_at(events: DataFrame, keys: list[str], pos: Column) -> DataFrame:
    """Orders live at a position: keys, order_id, side, price, remaining."""
    e = events.where(F.col("pos") <= pos)
    w = Window.partitionBy(*keys, "order_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("life", F.sum((F.col("kind") == "add").cast("bigint")).over(w)).where("life > 0")
    ends = F.max((F.col("kind") == "cancel") | ((F.col("kind") == "execute") & F.coalesce(F.col("full_fill"), F.lit(False))))
    is_add, done = F.col("kind") == "add", F.coalesce(F.sum(F.when(F.col("kind") == "execute", F.col("qty"))), F.lit(0))
    lives = e.groupBy(*keys, "order_id", "life").agg(
        F.max(F.when(is_add, F.col("side"))).alias("side"), F.max(F.when(is_add, F.col("price"))).alias("price"),
        (F.max(F.when(is_add, F.col("qty"))) - done).cast("bigint").alias("remaining"), ends.alias("ended"),
    )
    last = lives.groupBy(*keys, "order_id").agg(F.max_by(F.struct("side", "price", "remaining", "ended"), "life").alias("l"))
    return last.select(*keys, "order_id", "l.*").where("not ended and remaining > 0").drop("ended")


def versions(lives: DataFrame, keys: list[str]) -> DataFrame:
    """What each event of ``lives`` (of ``with_versions``) leaves of its order: keys, order_id, side, price, flags, enter_ts, remaining, from
    per_seq to before until (null: no later event). Events that leave nothing alive have no row."""
    is_fill, full = F.col("kind") == "execute", F.coalesce(F.col("full_fill"), F.lit(False))
    before = F.col("entry_qty") - F.col("filled")
    left = before - F.when(is_fill & (F.col("qty") <= before), F.col("qty")).otherwise(0)
    gone = F.col("removed") | (F.col("kind") == "cancel") | (is_fill & full)
    entry = {"side": F.col("entry_side"), "price": F.col("entry_price"), "flags": F.col("first_flags"), "enter_ts": F.col("first_enter_ts")}
    e = lives.withColumns({"remaining": left.cast("bigint"), "gone": gone} | entry)
    return e.where("life > 0 and not gone and remaining > 0").select(*keys, "order_id", "side", "price", "flags", "enter_ts", "remaining", "per_seq", "until")


def to_levels(live: DataFrame, keys: list[str]) -> DataFrame:
    """Orders added up to price levels: keys, side, price, qty, orders."""
    return live.groupBy(*keys, "side", "price").agg(F.sum("remaining").alias("qty"), F.count("*").alias("orders"))


def rolled_up(trades: DataFrame, executions: DataFrame, keys: list[str]) -> DataFrame:
    """Trades with what their executions add up to: n_executions, executed, and agrees (the quantities are the same)."""
    e = executions.where("trade_id <> 0").groupBy(*keys, "trade_id").agg(F.count("*").alias("n_executions"), F.sum("qty").cast("bigint").alias("executed"))
    out = trades.join(e, [*keys, "trade_id"], "left").na.fill(0, ["n_executions", "executed"])
    return out.withColumn("agrees", F.col("executed") == F.col("qty"))


def arbitrated(rows: DataFrame, keys: list[str], source: str, preferred: list[str]) -> DataFrame:
    """Rows of one instance for each key: the first of ``preferred`` that has any. Instances are never mixed, as their
    numberings have nothing to do with each other."""
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col(source))
    best = rows.where(rank > 0).groupBy(*keys).agg(F.min_by(source, rank).alias("__best"))
    return rows.join(best, keys).where(F.col(source) == F.col("__best")).drop("__best")
