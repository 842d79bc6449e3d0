"""Snapshot groups: islands of begin, rows and end; their structure; the comparison with the rebuilt book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .ordered import with_islands, with_previous, with_run_length


def groups(rows: DataFrame, keys: list[str], order: str = "pos", at: Column | None = None, tasks: int | None = None) -> DataFrame:
    """rows: kind (begin, row, end), snapshot_id, instrument, anchor, total, key of the row. A row per group: declared
    and received rows, duplicate keys, ids that differ from the begin's, whether its end came and agrees with it.

    Rows before any begin, and after their group's end, are in no group and are counted as orphans of the one before. All is
    worked out over one sort of a task's rows by group, key and order; ``at`` and ``tasks`` are those of ``with_islands``, for
    rows without an island."""
    r = rows if "island" in rows.columns else with_islands(rows, keys, F.col("kind") == "begin", [order], at=at, tasks=tasks)
    r = r.repartition(tasks, *keys, "island") if tasks else r
    r = r.withColumn("__key", F.when(F.col("kind") == "row", F.col("key")))
    group = Window.partitionBy(*keys, "island")
    r = r.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys, "island", "__key").orderBy(order)))
    first = {f"begin_{c}": F.max(F.when(F.col("kind") == "begin", F.col(c))).over(group) for c in ("snapshot_id", "instrument", "anchor", "total")}
    r = r.withColumns(first | {"__end": F.min(F.when(F.col("kind") == "end", F.col(order))).over(group)})
    orphan = (F.col("island") == 0) | F.coalesce(F.col(order) > F.col("__end"), F.lit(False))
    own = (F.col("kind") == "row") & ~orphan
    end = (F.col("kind") == "end") & ~orphan
    agrees = (F.col("snapshot_id") == F.col("begin_snapshot_id")) & (F.col("instrument") == F.col("begin_instrument")) & (F.col("anchor") == F.col("begin_anchor"))
    fresh = own & (F.col("__nth") == 1) & F.col("__key").isNotNull()
    made = {
        "received": F.count_if(own).over(group), "duplicates": F.count_if(own).over(group) - F.count_if(fresh).over(group),
        "wrong_id": F.count_if(own & (F.col("snapshot_id") != F.col("begin_snapshot_id"))).over(group), "ended": F.coalesce(F.max(end).over(group), F.lit(False)),
        "end_differs": F.coalesce(F.max(end & ~agrees).over(group), F.lit(False)), "orphans": F.count_if(orphan).over(group), "begin_pos": F.min(order).over(group),
    }
    r = r.withColumns(made | {"__row": F.row_number().over(group.orderBy("__key", order))}).where("__row = 1")
    return r.select(*keys, "island", *(F.col(f"begin_{c}").alias(c) for c in ("snapshot_id", "instrument", "anchor", "total")), *made)


def few_groups(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """What ``groups`` gives of rows with an island, where the groups are few and each may be long: what begins and ends say
    goes to all tasks, the rest is aggregates. With what the engine asks of a group besides: last_seq, end_pos, seq (the first),
    torn (a frame was lost between its begin and its last row), port_dirty, and before, the frames lost at its begin."""
    own_keys = [*keys, "island"]
    names = ("snapshot_id", "instrument", "anchor", "total")
    marks = rows.where("kind <> 'row' or island = 0").groupBy(*own_keys).agg(
        *(F.max(F.when(F.col("kind") == "begin", F.col(c))).alias(f"begin_{c}") for c in names), F.min(F.when(F.col("kind") == "end", F.col(order))).alias("__end"),
        F.min(order).alias("begin_pos"), F.max(F.when(F.col("kind") == "end", F.col(order))).alias("end_pos"), F.min_by("seq", order).alias("__seq"),
    )
    marks = cut(marks)
    r = rows.join(F.broadcast(marks), own_keys)
    orphan = (F.col("island") == 0) | F.coalesce(F.col(order) > F.col("__end"), F.lit(False))
    own, end = (F.col("kind") == "row") & ~orphan, (F.col("kind") == "end") & ~orphan
    agrees = (F.col("snapshot_id") == F.col("begin_snapshot_id")) & (F.col("instrument") == F.col("begin_instrument")) & (F.col("anchor") == F.col("begin_anchor"))
    made = r.groupBy(*own_keys).agg(
        F.count_if(own).alias("received"), F.count_distinct(F.when(own, F.col("key"))).alias("__distinct"), F.count_if(own & (F.col("snapshot_id") != F.col("begin_snapshot_id"))).alias("wrong_id"),
        F.coalesce(F.max(end), F.lit(False)).alias("ended"), F.coalesce(F.max(end & ~agrees), F.lit(False)).alias("end_differs"), F.count_if(orphan).alias("orphans"),
        F.max("last_seq").alias("last_seq"), F.max((F.col("seq") > F.col("__seq")) & (F.col("lost_frames") > 0)).alias("torn"), F.min("seq").alias("seq"),
        F.max(F.coalesce("dirty", F.lit(False))).alias("port_dirty"), F.max(F.col("lost_frames") * F.when(F.col("kind") == "begin", 1).otherwise(0)).alias("before"),
    )
    made = made.withColumn("duplicates", F.col("received") - F.col("__distinct")).join(F.broadcast(marks), own_keys)
    more = ("last_seq", "torn", "end_pos", "seq", "port_dirty", "before")
    return made.select(*own_keys, *(F.col(f"begin_{c}").alias(c) for c in names), "received", "duplicates", "wrong_id", "ended", "end_differs", "orphans", "begin_pos", *more)


def repeated_keys(rows: DataFrame, keys: list[str], order: str = "pos", at: Column | None = None, tasks: int | None = None) -> DataFrame:
    """keys, island, snapshot_id of the begin, key, n: keys of more than one row between a begin and the next."""
    r = with_islands(rows, keys, F.col("kind") == "begin", [order], at=at, tasks=tasks).where("island > 0")
    r = r.repartition(tasks, *keys, "island") if tasks else r
    own = Window.partitionBy(*keys, "island", "kind", "key")
    r = r.withColumns({"n": F.count("*").over(own), "__nth": F.row_number().over(own.orderBy(order))})
    r = r.withColumn("snapshot_id", F.max(F.when(F.col("kind") == "begin", F.col("snapshot_id"))).over(Window.partitionBy(*keys, "island")))
    return r.where("kind = 'row' and __nth = 1 and n > 1").select(*keys, "island", "snapshot_id", "key", "n")


def with_anchor_checks(begins: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Begins with anchor_status (equal anchors pass) and id_status (an equal id is a violation); the first is open."""
    b = with_previous(begins, keys, [order], prev_anchor="anchor", prev_id="snapshot_id")
    status = lambda bad: F.when(F.col("prev_anchor").isNull(), "unverifiable").when(bad, "violation").otherwise("pass")
    return b.withColumn("anchor_status", status(F.col("anchor") < F.col("prev_anchor"))).withColumn("id_status", status(F.col("snapshot_id") <= F.col("prev_id")))


def book_diff(snapshot: DataFrame, book: DataFrame, keys: list[str], on: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: keys, on, field and both values of every difference; field is "missing" or "extra" for
    rows of one side only (missing: in the snapshot, not in the book)."""
    s = snapshot.select(*keys, *on, *(F.col(v).alias(f"s_{v}") for v in values), F.lit(True).alias("in_s"))
    b = book.select(*keys, *on, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(True).alias("in_b"))
    both = s.join(b, [*keys, *on], "full_outer")
    differs = [F.when(F.col("in_s").isNotNull() & F.col("in_b").isNotNull() & ~F.col(f"s_{v}").eqNullSafe(F.col(f"b_{v}")), F.struct(F.lit(v).alias("field"), F.col(f"s_{v}").cast("string").alias("snapshot_value"), F.col(f"b_{v}").cast("string").alias("book_value"))) for v in values]
    alone = F.when(F.col("in_b").isNull() | F.col("in_s").isNull(), F.struct(F.when(F.col("in_b").isNull(), "missing").otherwise("extra").alias("field"), F.col(f"s_{values[0]}").cast("string").alias("snapshot_value"), F.col(f"b_{values[0]}").cast("string").alias("book_value")))
    return both.withColumn("d", F.explode(F.array_compact(F.array(alone, *differs)))).select(*keys, *on, "d.*")


def signatures(diff: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """keys, n_diffs, signature (all differences in order) and shown (the first three and how many more)."""
    one = F.concat_ws(":", *(F.col(c).cast("string") for c in on), "field")
    g = diff.groupBy(*keys).agg(F.count("*").alias("n_diffs"), F.array_sort(F.collect_list(one)).alias("__all"))
    more = F.when(F.size("__all") > 3, F.concat(F.lit(" +"), (F.size("__all") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return g.withColumn("signature", F.array_join("__all", ",")).withColumn("shown", F.concat(F.array_join(F.slice("__all", 1, 3), ","), more)).drop("__all")


def oracle_status(audits: DataFrame, keys: list[str], order: str, cycles: int = 2) -> DataFrame:
    """audits: a row per compared group with signature ("" where it matches, null where it can't be verified). A
    mismatch is suspected until the same signature came ``cycles`` times in a row, and a violation from then on."""
    mismatch = F.coalesce(F.col("signature") != "", F.lit(False))
    out = with_run_length(audits, keys, [order], F.col("signature"), mismatch)
    return out.withColumn("status", F.when(F.col("signature").isNull(), "unverifiable").when(~mismatch, "pass").when(F.col("run_length") >= cycles, "violation").otherwise("suspected"))


def recovery(resets: DataFrame, groups_done: DataFrame, keys: list[str]) -> DataFrame:
    """Resets with the first completed group after each (group_pos, group_anchor), and status: the anchors must agree;
    without a group there is nothing that follows."""
    from .ordered import asof

    g = groups_done.select(*keys, "pos", F.col("pos").alias("group_pos"), F.col("anchor").alias("group_anchor"))
    out = asof(resets, g, keys, "pos", ["group_pos", "group_anchor"], strict=True, forward=True)
    return out.withColumn("status", F.when(F.col("group_pos").isNull(), "violation").when(F.col("group_anchor") == F.col("anchor"), "pass").otherwise("violation"))


def verdict(cases: list[tuple[Column, str, str | None]]) -> Column:
    """(status, reason) of the first case that holds, in order; pass if none does."""
    out = F.struct(F.lit("pass").alias("status"), F.lit(None).cast("string").alias("reason"))
    for when, status, reason in reversed(cases):
        out = F.when(when, F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))).otherwise(out)
    return out
