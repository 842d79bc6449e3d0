"""Price-level books: ladders as of a sequence number, clears, the inside, depth, and action checks.

updates: keys, per_seq, side, price, qty (absolute; 0 removes), action. clears: keys, per_seq, clear_side (0 bid, 1 ask,
2 both), scope (0 whole, 1 range), from_price.

A ladder is the last update of each price that no later clear covers, found by windows and aggregations: nothing is
replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import asof, asof_few


def covers() -> Column:
    """Whether a clear covers a level: range clears take bids at or below and asks at or above from_price."""
    side = (F.col("clear_side") == 2) | (F.col("clear_side") == F.col("side"))
    bid, ask = (F.col("side") == 0) & (F.col("price") <= F.col("from_price")), (F.col("side") == 1) & (F.col("price") >= F.col("from_price"))
    return side & ((F.col("scope") == 0) | bid | ask)


def ladder(updates: DataFrame, keys: list[str], clears: DataFrame | None = None) -> DataFrame:
    """keys, side, price, qty, per_seq of the levels standing after all rows.

    Of each price the last update counts, and falls if a later clear of its side reaches its price: one running extreme
    of ``from_price``, from the last row back, over (keys, side). Clears meet no prices in a join."""
    u = updates.select(*keys, "side", "price", "per_seq", "qty")
    last = u.groupBy(*keys, "side", "price").agg(F.max_by("qty", "per_seq").alias("qty"), F.max("per_seq").alias("per_seq"))
    if clears is None:
        return last.where("qty > 0")
    sides = F.when(F.col("clear_side") == 2, F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).otherwise(F.array(F.col("clear_side").cast("bigint")))
    c = clears.select(*keys, "per_seq", F.explode(sides).alias("side"), (F.col("scope") == 0).alias("__whole"), "from_price")
    both = last.unionByName(c, allowMissingColumns=True)
    later = Window.partitionBy(*keys, "side").orderBy(F.desc("per_seq")).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max("__whole").over(later), F.lit(False))
    gone = gone | F.coalesce(F.when(F.col("side") == 0, F.max("from_price").over(later) >= F.col("price")).otherwise(F.min("from_price").over(later) <= F.col("price")), F.lit(False))
    return both.withColumn("__gone", gone).where("price is not null and not __gone and qty > 0").select(*keys, "side", "price", "qty", "per_seq")


def ladder_asof(updates: DataFrame, points: DataFrame, keys: list[str], clears: DataFrame | None = None) -> DataFrame:
    """The ladders at each of ``points`` (keys, k): keys, k, side, price, qty.

    Updates get the interval of sequence numbers up to the price's next one, and are repeated for the points in it. A
    clear belongs to the first point that it comes before; a level falls at the first of its points at which the running
    extreme of the clears since it was set reaches its price. Clears meet no prices in a join."""
    w = Window.partitionBy(*keys, "side", "price").orderBy("per_seq")
    u = updates.select(*keys, "side", "price", "per_seq", "qty").withColumn("until", F.lead("per_seq").over(w)).where("qty > 0")
    standing = at_points(u, points, keys, "per_seq", "until")
    if clears is None:
        return standing.select(*keys, "k", "side", "price", "qty")
    # One measure for both sides: a clear reaches a level if its reach is not below the level's.
    sides = F.when(F.col("clear_side") == 2, F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).otherwise(F.array(F.col("clear_side").cast("bigint")))
    c = clears.select(*keys, F.col("per_seq").cast("bigint").alias("__at"), F.explode(sides).alias("side"), "scope", "from_price")
    c = c.withColumn("__reach", F.expr(f"if(scope = 0, {(1 << 63) - 1}, if(side = 0, from_price, -from_price))").cast("bigint"))
    ends = points.select(*keys, F.col("k").cast("bigint").alias("__at"), "k").distinct()
    c = asof(c.select(*keys, "side", "__at", "__reach"), ends, keys, "__at", ["k"], forward=True).where("k is not null")
    part = [*keys, "side", "k"]
    whole = c.groupBy(*part).agg(F.max("__reach").alias("__part"))
    # At a level's first point only the clears after it count.
    own = Window.partitionBy(*keys, "side", "price", "per_seq").orderBy("k")
    first = standing.withColumn("__nth", F.row_number().over(own))
    later = Window.partitionBy(*part).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
    begun = first.where("__nth = 1").withColumn("__at", F.col("per_seq").cast("bigint")).unionByName(c, allowMissingColumns=True)
    begun = begun.withColumn("__since", F.max("__reach").over(later)).where("price is not null")
    rest = first.where("__nth > 1").join(whole, part, "left")
    both = begun.select(*first.columns, "__since").unionByName(rest.select(*first.columns, F.col("__part").alias("__since")))
    reached = F.max("__since").over(own.rowsBetween(Window.unboundedPreceding, 0)) >= F.when(F.col("side") == 0, F.col("price")).otherwise(-F.col("price"))
    return both.withColumn("__gone", F.coalesce(reached, F.lit(False))).where("not __gone").select(*keys, "k", "side", "price", "qty")


def at_points(spans: DataFrame, points: DataFrame, keys: list[str], start: str, until: str, few: bool = False) -> DataFrame:
    """``spans`` once for each of ``points`` (keys, k) with start <= k < until (null: no end), by equality joins only. ``few``
    says that the points may go to all tasks."""
    join = asof_few if few else asof
    p = points.select(*keys, "k").distinct().withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("k")))
    dims = p.select(*keys, F.col("k").cast("bigint").alias("__at"), F.col("__n").alias("__first"))
    s = join(spans.withColumn("__at", F.col(start).cast("bigint")), dims, keys, "__at", ["__first"], forward=True)
    s = s.where("__first is not null").withColumn("__at", F.coalesce(F.col(until).cast("bigint"), F.lit((1 << 63) - 1)))
    s = join(s, dims.withColumnRenamed("__first", "__last"), keys, "__at", ["__last"], strict=True).where("__first <= __last")
    s = s.withColumn("__n", F.explode(F.sequence("__first", "__last"))).drop("__at", "__first", "__last")
    return s.join(F.broadcast(p) if few else p, [*keys, "__n"]).drop("__n")


def inside(levels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best_bid, best_ask, crossed (a bid above an ask; both sides present)."""
    best = levels.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == 1, F.col("price"))).alias("best_ask"))
    return best.withColumn("crossed", F.coalesce(F.col("best_bid") > F.col("best_ask"), F.lit(False)))


def ranked(levels: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """Levels with level_no from 1 at the inside of each side, down to ``depth``."""
    nearness = F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price"))
    out = levels.withColumn("level_no", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(nearness)))
    return out if depth is None else out.where(F.col("level_no") <= depth)


def absolute_apply(updates: DataFrame) -> DataFrame:
    """Updates whose action and quantity contradict each other: no quantity without a delete, or a delete with one."""
    return updates.where("(qty = 0 and action <> 2) or (qty <> 0 and action = 2)")


def malformed_clears(clears: DataFrame) -> DataFrame:
    """Range clears on both sides: reported, and not applied."""
    return clears.where("scope = 1 and clear_side = 2")


def action_divergence(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates with divergence: new_on_present, change_on_absent, or null (actions 0 new, 1 change, 2 delete)."""
    w = Window.partitionBy(*keys, "side", "price").orderBy("per_seq")
    present = F.coalesce(F.lag("qty").over(w), F.lit(0)) > 0
    what = F.when((F.col("action") == 0) & present, "new_on_present").when((F.col("action") == 1) & ~present, "change_on_absent")
    return updates.withColumn("divergence", what)
