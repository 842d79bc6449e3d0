"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint, a <> b); root is the same for all of a component.

    Each round hooks every node to its least neighbour, shortens the chains by pointer doubling, and contracts the
    edges to the hooked labels. Hooks only go to smaller ids, so there are no cycles; an edge between a node and its
    hook becomes the edge between their hooks, so contraction keeps what is connected. Minima are combined before the
    shuffle; the joins read written tables on both sides, so a hub's rows can be split among tasks.
    An empty edge table gives an empty result.
    """
    e = scratch.table(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-e0"
    )
    labels, step = None, 0
    while labels is None or not e.isEmpty():
        step += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("p"))
        hook = scratch.table(hook, f"{name}-h{step}")
        twice = hook.alias("x").join(hook.alias("y"), F.col("x.p") == F.col("y.u")).select("x.u", "y.p")
        hook = scratch.table(twice, f"{name}-hh{step}")
        if labels is None:
            labels = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = labels.join(hook, F.col("root") == F.col("u"), "left")
            labels = scratch.table(moved.select("node", F.coalesce("p", "root").alias("root")), f"{name}-l{step}")
        a, b = hook.toDF("ua", "pa"), hook.toDF("ub", "pb")
        met = e.join(a, F.col("a") == F.col("ua")).join(b, F.col("b") == F.col("ub")).where("pa <> pb")
        new = met.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        e = scratch.table(new, f"{name}-e{step}")
    return labels
