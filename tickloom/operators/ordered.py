"""Ordered operators: as-of joins, sequencing of frames, per-instrument sequences, sticky flags, runs and islands.

Each is one window (one shuffle on its keys). Where state depends on what was accepted before, only the few rows at
which it can change are folded. With ``Slices``, a key's rows are spread over tasks by where they are in the order, and each
slice goes on from what those before it come to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.storage import cut

#: Rows of a key that a task takes at once, rows of a slice of the order of keys with more, and slices of a task on average.
KEY_ROWS = 2_000_000
SLICE_ROWS = 250_000
_A_TASK = 2


def _before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _until(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _first_of(rows: DataFrame, pos: str) -> Column:
    """The whole number that goes first in ``pos``, a number or a position of the engine."""
    return F.col(f"{pos}.emit_pos") if isinstance(rows.schema[pos].dataType, StructType) else F.col(pos)


@dataclass(frozen=True)
class Slices:
    """Cuts of an order at whole numbers that go first in it: slice i begins at ``bounds[i - 1]``. ``tasks`` is how many
    tasks the slices of all keys are dealt over."""

    bounds: tuple[int, ...]
    tasks: int

    def of(self, at: Column) -> Column:
        """The slice of ``at`` by a binary search: how many bounds are at or below."""
        bounds, size = F.array(*(F.lit(b).cast("bigint") for b in self.bounds)), 1 << len(self.bounds).bit_length()
        steps = F.array(*(F.lit(size >> k) for k in range(1, size.bit_length())))
        return F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(bounds, i + s - 1) <= at, i + s).otherwise(i))

    def spread(self, rows: DataFrame, keys: list[str], at: Column, **totals: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
        """``rows`` with __slice, by keys and slice in tasks, and with what the slices before come to: an aggregate of a
        slice, and the one that runs over these. A row a key and slice is sent to all tasks."""
        out = rows.withColumn("__slice", self.of(at))
        if totals:
            own = [*keys, "__slice"]
            t = out.groupBy(*own).agg(*(total.alias(name) for name, (total, _) in totals.items()))
            t = t.select(*own, *(run(F.col(name)).over(_before(keys, ["__slice"])).alias(name) for name, (_, run) in totals.items()))
            out = out.join(F.broadcast(t), own)
        return out.repartition(self.tasks, *keys, "__slice")


def slices(rows: DataFrame, keys: list[str], *numbers: str, size: int | None = None, key_rows: int | None = None) -> list[Slices | None]:
    """Slices of ``size`` rows of all keys together by each of ``numbers``; None where no key has more rows than a task takes
    (``size``, ``key_rows`` or ``KEY_ROWS``), as slices cost a pass or two more."""
    most, n = rows.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) <= (size or key_rows or KEY_ROWS):
        return [None for _ in numbers]
    count = -(-n // (size or SLICE_ROWS))
    at = [k / count for k in range(1, count)]
    got = rows.agg(*(F.percentile_approx(F.col(c).cast("bigint"), at, 10 * count).alias(f"b{i}") for i, c in enumerate(numbers))).first()
    tasks = max(-(-count // _A_TASK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return [Slices(tuple(sorted(set(b))), tasks) if b else None for b in got]


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, cuts: Slices | None = None) -> DataFrame:
    """``rows`` with their number from 1 in ``order``, by whose first column ``cuts`` are."""
    if cuts is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    out = cuts.spread(rows, keys, F.col(order[0]), __carry=(F.count("*"), F.sum))
    place = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order)) + F.coalesce("__carry", F.lit(0))
    return out.withColumn(name, place.cast("bigint")).drop("__carry", "__slice")


def asof(facts: DataFrame, dims: DataFrame, keys: list[str], pos: str, values: list[str], strict: bool = False, forward: bool = False, cuts: Slices | None = None) -> DataFrame:
    """Each fact with the ``values`` of the last dim at or before its ``pos`` (``strict``: before; ``forward``: after).

    Both sides are united and the last dim is carried over the order, so there is one shuffle and no range join. With
    ``cuts`` by ``pos``, each slice begins with the last dim of the slices before."""
    d = dims.selectExpr(*keys, pos, f"{int(strict)} as __side", f"struct({', '.join(values)}) as __dim")
    f = facts.selectExpr(*keys, pos, f"{int(not strict)} as __side", f"struct({', '.join(facts.columns)}) as __fact")
    both = f.unionByName(d, allowMissingColumns=True)
    # Forward is backward in the other order: a frame that ends with its partition is worked out anew for each row.
    order = f"{pos} desc" if forward else pos
    if cuts:
        at = _first_of(facts, pos)
        # The dim that a slice ends with in the order of the window, and the last of those for every slice of the key.
        ends = d.withColumn("__slice", cuts.of(at)).groupBy(*keys, "__slice").agg((F.min_by if forward else F.max_by)("__dim", pos).alias("__dim"))
        every = ends.select(*keys).distinct().withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(len(cuts.bounds)))))
        earlier = Window.partitionBy(*keys).orderBy(F.desc("__slice") if forward else F.asc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.join(ends, [*keys, "__slice"], "left").withColumn("__dim", F.last("__dim", ignorenulls=True).over(earlier)).where("__dim is not null")
        both = both.withColumn("__slice", cuts.of(at)).withColumn("__own", F.lit(1)).unionByName(carried.withColumn("__own", F.lit(0)), allowMissingColumns=True)
        both = both.repartition(cuts.tasks, *keys, "__slice")
        keys, order = [*keys, "__slice"], f"__own, {order}"
    seen = f"last(__dim, true) over (partition by {', '.join(keys)} order by {order}, __side rows between unbounded preceding and current row) as __seen"
    return both.selectExpr("__fact", seen).where("__fact is not null").selectExpr("__fact.*", *(f"__seen.{v} as {v}" for v in values))


#: Rows of a side of an as-of join that all tasks may hold.
FEW = 10_000


def is_few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def _lists(rows: DataFrame, keys: list[str], pos: str, what: Column) -> tuple[DataFrame, int]:
    """A row for each of ``keys`` with __list, the sorted (pos, x) of its few rows, and how many the longest has."""
    lists = cut(rows.groupBy(*(F.col(c).alias(f"__{c}") for c in keys)).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), what.alias("x")))).alias("__list")))
    return F.broadcast(lists), lists.agg(F.max(F.size("__list"))).first()[0] or 0


def _listed(rows: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(lists, same, "left").drop(*(f"__{c}" for c in keys))


def _how_many(pos: Column, most: int, at_too: bool) -> Column:
    """How many of __list are before ``pos``, or at it if ``at_too``, by a binary search."""
    size = 1 << most.bit_length()
    steps = F.array(*(F.lit(size >> k) for k in range(1, size.bit_length())))

    def step(i: Column, s: Column) -> Column:
        there = F.get("__list", i + s - 1)["pos"]
        return F.when(there <= pos if at_too else there < pos, i + s).otherwise(i)

    return F.aggregate(steps, F.lit(0), step) if most else F.lit(0)


def asof_few(facts: DataFrame, dims: DataFrame, keys: list[str], pos: str, values: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """What ``asof`` gives where the dims are few: these go to all tasks, and facts stay where they are, without a shuffle."""
    kind = facts.schema[pos].dataType.simpleString()
    lists, most = _lists(dims.withColumn(pos, F.col(pos).cast(kind)), keys, pos, F.struct(*values))
    n = _how_many(F.col(pos), most, strict == forward)
    seen = F.get("__list", n if forward else n - 1)["x"]
    out = _listed(facts, lists, keys).withColumn("__seen", F.when(F.col(pos).isNotNull(), seen))
    return out.select(*facts.columns, *(F.col("__seen")[v].alias(v) for v in values))


def asof_of_few(facts: DataFrame, dims: DataFrame, keys: list[str], pos: str, values: list[str]) -> DataFrame:
    """What ``asof`` gives where the facts are few: of the dims between two facts the last is kept, by tasks first."""
    kind = dims.schema[pos].dataType.simpleString()
    lists, most = _lists(facts.select(*keys, F.col(pos).cast(kind).alias(pos)).distinct(), keys, pos, F.lit(0))
    d = _listed(dims.select(*keys, pos, *values), lists, keys).where("__list is not null").withColumn("__n", _how_many(F.col(pos), most, False)).where("__n < size(__list)")
    last = d.groupBy(*keys, "__n").agg(F.max_by(F.struct(pos, *values), pos).alias("__d")).select(*keys, "__d.*")
    return asof_few(facts, last, keys, pos, values)


def with_duplicates(frames: DataFrame, keys: list[str], payload: str, arrival: str = "arrival") -> DataFrame:
    """``frames`` with copy_no (0 for the first of its keys) and divergent (a copy whose payload is not the first's)."""
    w = Window.partitionBy(*keys).orderBy(arrival)
    first = F.first(payload).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("copy_no", F.row_number().over(w) - 1).withColumn("divergent", ~F.col(payload).eqNullSafe(first))


def with_ring(rows: DataFrame, keys: list[str], seq: str, order: list[str], payload: str, size: int) -> DataFrame:
    """``rows`` with divergent: one of the ``size`` rows before has the same ``seq`` and another payload."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    w = Window.partitionBy(*keys, seq).orderBy(*order)
    out = rows.withColumn("__n", place).withColumn("__gap", F.col("__n") - F.lag("__n").over(w)).withColumn("__was", F.lag(payload).over(w))
    return out.withColumn("divergent", F.coalesce((F.col("__gap") <= size) & (F.col("__was") != F.col(payload)), F.lit(False))).drop("__n", "__gap", "__was")


def with_gaps(rows: DataFrame, keys: list[str], seq: str, order: list[str], cuts: Slices | None = None) -> DataFrame:
    """``rows`` with prev_max, missing (numbers skipped since the greatest so far) and backward (at or below... it).
    ``cuts`` are by ``order``."""
    if cuts:
        rows = cuts.spread(rows, keys, _first_of(rows, order[0]), __top=(F.max(seq), F.max))
        rows = rows.withColumn("prev_max", F.greatest("__top", F.max(seq).over(_before([*keys, "__slice"], order)))).drop("__top", "__slice")
    else:
        rows = rows.withColumn("prev_max", F.max(seq).over(_before(keys, order)))
    return rows.withColumn("missing", F.greatest(F.coalesce(F.col(seq) - F.col("prev_max") - 1, F.lit(0)), F.lit(0)).cast("bigint")).withColumn("backward", F.coalesce(F.col(seq) < F.col("prev_max"), F.lit(False)))


def with_sticky(rows: DataFrame, keys: list[str], flag: Column, order: list[str], name: str = "dirty") -> DataFrame:
    """``rows`` with a flag that stays set from its first row to the end of its keys."""
    return rows.withColumn(name, F.max(F.coalesce(flag, F.lit(False))).over(_until(keys, order)))


def with_previous(rows: DataFrame, keys: list[str], order: list[str], cuts: Slices | None = None, **columns: str) -> DataFrame:
    """``rows`` with columns that hold the previous row's values: name=column. ``cuts`` are by ``order``."""
    if cuts:
        one = F.struct(*(F.col(c).alias(name) for name, c in columns.items()))
        rows = cuts.spread(rows, keys, _first_of(rows, order[0]), __last=(F.max_by(one, order[0]), lambda c: F.last(c, ignorenulls=True)))
        was = F.coalesce(F.lag(one).over(Window.partitionBy(*keys, "__slice").orderBy(*order)), F.col("__last"))
        rows = rows.withColumn("__was", was)
        return rows.withColumns({name: F.col("__was")[name] for name in columns}).drop("__last", "__was", "__slice")
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({name: F.lag(c).over(w) for name, c in columns.items()})


#: Slices of a key's order, a power of two.
SLICES = 256


def with_islands(rows: DataFrame, keys: list[str], begins: Column, order: list[str], name: str = "island", at: Column | None = None, tasks: int | None = None) -> DataFrame:
    """``rows`` with the number of the last begin at or before; 0 before any.

    With ``at``, a whole number by which ``order`` goes first, a key's order is cut into ``SLICES`` at begins, each of which
    is numbered by itself, in ``tasks`` tasks, and goes on from the begins of the slices before: few keys with many rows
    are spread. What is sent to all tasks is two arrays a key."""
    if at is None:
        return rows.withColumn(name, F.sum(F.when(begins, 1).otherwise(0)).over(_until(keys, order)).cast("bigint"))
    rows = rows.withColumn("__at", at.cast("bigint"))
    first = rows.where(begins & F.col("__at").isNotNull()).select(*keys, "__at")
    bounds = first.groupBy(*keys).agg(F.percentile_approx("__at", [k / SLICES for k in range(1, SLICES)], 10 * SLICES).alias("__bounds"))
    bounds = cut(bounds)  # worked out once, as approximate bounds may be others the next time
    # A binary search for how many bounds are at or below.
    steps = F.array(*(F.lit(SLICES >> k) for k in range(1, SLICES.bit_length())))
    slice_of = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get("__bounds", i + s - 1) <= F.col("__at"), i + s).otherwise(i))
    begun = first.join(F.broadcast(bounds), keys).select(*keys, slice_of.alias("__slice")).groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    begun = begun.withColumn("__before", F.coalesce(F.sum("__n").over(_before(keys, ["__slice"])), F.lit(0)))
    numbers = begun.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__slice", "__before"))).alias("__numbers"))
    out = rows.join(F.broadcast(bounds.join(numbers, keys)), keys, "left").withColumn("__slice", slice_of)
    # Rows before a key's first begin are in slice 0, which has no begin before it.
    out = out.withColumn("__start", F.coalesce(F.try_element_at("__numbers", F.col("__slice")), F.lit(0))).drop("__at", "__bounds", "__numbers")
    out = out.repartition(tasks, *keys, "__slice") if tasks else out
    island = F.col("__start") + F.sum(F.when(begins, 1).otherwise(0)).over(_until([*keys, "__slice"], order))
    return out.withColumn(name, island.cast("bigint")).drop("__slice", "__start")


def with_run_length(rows: DataFrame, keys: list[str], order: list[str], value: Column, counts: Column, name: str = "run_length") -> DataFrame:
    """``rows`` with the length so far of the run of equal ``value`` among consecutive rows that count; else 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("__v", value).withColumn("__c", counts)
    starts = ~F.col("__c") | ~F.coalesce(F.lag("__c").over(w), F.lit(False)) | ~F.col("__v").eqNullSafe(F.lag("__v").over(w))
    out = out.withColumn("__run", F.sum(starts.cast("int")).over(_until(keys, order)))
    length = F.when(F.col("__c"), F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(*order))).otherwise(0)
    return out.withColumn(name, length.cast("bigint")).drop("__v", "__c", "__run")


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def scanned(rows: DataFrame, keys: list[str], order: str, columns: list[str], make: Callable[[], Callable[..., tuple]], result: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``result`` (name to type), where state depends on what was accepted before.

    ``make`` gives a function for each key, which takes the values of ``columns`` of one row after the other in
    ``order`` and returns the new values. Rows stream past it, batch by batch, so neither time nor memory grows beyond
    the rows themselves. It is for the rows that can change state, of which there are few."""
    names = list(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            out = []
            own = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for key, values in zip(own, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if step is None or key != last:
                    last, step = key, make()
                out.append(step(*values))
            new = [pa.array([o[k] for o in out], _ARROW[result[name]]) for k, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    more = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in result.items()))
    schema = StructType([*rows.schema.fields, *more.fields])
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _reset_changes(frames: DataFrame, keys: list[str], reset: str, order: str) -> DataFrame:
    """``frames`` with __change (another reset count than the frame before) and __span, the number of the last change."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = frames.withColumn("__change", F.coalesce(F.col(reset) != F.lag(reset).over(w), F.lit(True)))
    return f.withColumn("__span", F.sum(F.col("__change").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def _with_decided(f: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``f`` with what was decided at the change that began their span."""
    out = f.join(decided.select(*keys, "__span", "era_no", "era_state"), [*keys, "__span"])
    return out.withColumn("era_state", F.when((F.col("era_state") == "newer") & ~F.col("__change"), "same").otherwise(F.col("era_state"))).drop("__change", "__span")


def with_eras(frames: DataFrame, keys: list[str], reset: str = "reset_count", order: str = "arrival") -> DataFrame:
    """``frames`` with era_no and era_state: same, newer (a frame that opens an era), older or ambiguous.

    A reset count 1 to 127 ahead of the last accepted one is newer; 128 ahead is ambiguous, more is older, and neither
    is accepted. era_no counts the accepted eras. Only the rows at which the count changes are scanned, and their
    decisions are carried to the rows between."""
    f = _reset_changes(frames, keys, reset, order)

    def make():
        count, era = None, 0

        def step(new: int) -> tuple[int, str]:
            nonlocal count, era
            ahead = 0 if count is None else (new - count) % 256
            if ahead >= 128:
                return era, "ambiguous" if ahead == 128 else "older"
            count, era = new, era + (ahead > 0)
            return era, "newer" if ahead else "same"

        return step

    changes = f.where("__change").select(*keys, "__span", F.col(reset).cast("bigint").alias("__reset"))
    return _with_decided(f, scanned(changes, keys, "__span", ["__reset"], make, {"era_no": "bigint", "era_state": "string"}), keys)


def _era_step():
    """For a channel: a function of a port's name and its next reset count, which gives era_no and era_state."""
    ports: dict[str, tuple[int, int]] = {}
    newest: tuple[int, int] | None = None

    def step(name: str, new: int) -> tuple[int, str]:
        nonlocal newest
        if name in ports:
            era, count = ports[name]
            ahead = (new - count) % 256
            if ahead >= 128:
                return era, "ambiguous" if ahead == 128 else "older"
        else:
            era, ahead = (0, 0) if newest is None else (newest[0] + (new - newest[1] + 128) % 256 - 128, 0)
        ports[name] = (era + ahead, new)
        newest = max(newest or ports[name], ports[name])
        return era + ahead, "newer" if ahead else "same"

    return step


def with_eras_of_counts(frames: DataFrame, keys: list[str], port: str, reset: str = "reset_count", order: str = "arrival") -> DataFrame | None:
    """What ``with_common_eras`` gives where every reset count of a port comes in one run, without a shuffle of frames: a
    few rows say where the runs begin. None where counts come again, or where the runs are many."""
    own = [*keys, port]
    runs = cut(frames.groupBy(*own, reset).agg(F.min(order).alias("__at"), F.max(order).alias("__to")))
    again = runs.withColumn("__was", F.lag("__to").over(Window.partitionBy(*own).orderBy("__at"))).where("__was >= __at")
    if not is_few(runs) or not again.isEmpty():
        return None
    changes = runs.select(*own, reset, "__at", F.col(reset).cast("bigint").alias("__reset"))
    decided = cut(scanned(changes, keys, "__at", [port, "__reset"], _era_step, {"era_no": "bigint", "era_state": "string"}))
    out = frames.join(F.broadcast(decided.drop("__reset")), [*own, reset])
    opens = (F.col("era_state") != "newer") | (F.col("__at") == F.col(order))
    return out.select(*frames.columns, "era_no", F.when(opens, F.col("era_state")).otherwise("same").alias("era_state"))


def with_common_eras(frames: DataFrame, keys: list[str], port: str, reset: str = "reset_count", order: str = "arrival", cuts: Slices | None = None) -> DataFrame:
    """``frames`` with era_state as by ``with_eras`` for each port, and an era_no that all ports of ``keys`` share: how
    many resets the channel has gone through since its first frame, by the reset counts themselves.

    A port that is silent in an era, or skips its count, has the right number in the next one. One scan goes over the
    changes of all ports in order of arrival. A port's first count is placed by its distance, -128 to 127, from the
    newest of the channel so far; numbers before the channel's first frame are negative. With ``cuts`` by ``order``, the
    first frame of a slice is scanned as well: it is decided as the frames before it were."""
    f = frames if cuts else _reset_changes(frames, [*keys, port], reset, order)

    if cuts:
        was = F.lag(reset).over(Window.partitionBy(*keys, port, "__slice").orderBy(order))
        changes = cuts.spread(f.select(*keys, port, order, reset), [*keys, port], F.col(order)).withColumn("__change", F.coalesce(F.col(reset) != was, F.lit(True)))
        changes = changes.withColumn("__span", F.col(order))
    else:
        changes = f
    changes = changes.where("__change").select(*keys, port, "__span", F.col(order).alias("__at"), F.col(reset).cast("bigint").alias("__reset"))
    decided = scanned(changes, keys, "__at", [port, "__reset"], _era_step, {"era_no": "bigint", "era_state": "string"})
    if cuts:
        decided = cut(decided).select(*keys, port, F.col("__at").alias(order), "era_no", "era_state", "__at")
        out = asof(f, decided, [*keys, port], order, ["era_no", "era_state", "__at"], cuts=cuts)
        opens = (F.col("era_state") != "newer") | (F.col("__at") == F.col(order))
        return out.withColumn("era_state", F.when(opens, F.col("era_state")).otherwise("same")).drop("__at")
    return _with_decided(f, decided, [*keys, port])


def with_late(frames: DataFrame, keys: list[str], seq: str = "seq", window: int = 8, arrival: str = "arrival", cuts: Slices | None = None) -> DataFrame:
    """``frames`` with late: more than ``window`` frames with a greater seq came before, so that a reorder buffer has let
    one of them go already.

    The k-th greatest seq so far is a running maximum over what the k-1 maxima before it pushed out, so the one that
    counts is ``window`` + 1 windows deep, all over the same partitions and order: one shuffle, one sort. With ``cuts`` by
    ``arrival``, the ``window`` + 1 greatest of the slices before come first in each slice."""
    before, out = _before(keys, [arrival]), frames
    if cuts:
        own = [*keys, "__slice"]
        nth = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc(seq)))
        top = frames.select(*keys, seq, cuts.of(F.col(arrival)).alias("__slice")).withColumn("__nth", nth).where(F.col("__nth") <= window + 1)
        top = top.groupBy(*own).agg(F.collect_list(seq).alias("__top"))
        most = F.slice(F.sort_array(F.flatten(F.collect_list("__top").over(_before(keys, ["__slice"]))), asc=False), 1, window + 1)
        top = top.select(*own, most.alias("__top")).select(*own, F.explode("__top").alias(seq), F.lit(0).alias("__own"))
        out = frames.withColumns({"__slice": cuts.of(F.col(arrival)), "__own": F.lit(1)}).unionByName(top, allowMissingColumns=True).repartition(cuts.tasks, *own)
        before = _before(own, ["__own", arrival])
    out = out.withColumn("__x", F.col(seq))
    for _ in range(window):
        out = out.withColumn("__top", F.max("__x").over(before)).withColumn("__x", F.when(F.col("__top").isNotNull(), F.least("__x", "__top")))
    out = out.withColumn("late", F.coalesce(F.max("__x").over(before) > F.col(seq), F.lit(False))).drop("__x", "__top")
    return out.where("__own = 1").drop("__slice", "__own") if cuts else out


def with_emit_position(frames: DataFrame, keys: list[str], seq: str = "seq", window: int = 8, arrival: str = "arrival", port_order: Column | None = None, cuts: tuple[Slices | None, Slices | None] = (None, None)) -> DataFrame:
    """``frames`` with emit_pos, the arrival at which a reorder buffer of ``window`` frames lets each go.

    A late frame leaves as it comes. Of the others the i-th in order of seq leaves when the (i + window)-th arrives; the
    last ones leave at the end, by port. ``cuts`` are by ``arrival`` and by ``seq``."""
    if window == 0:
        # The frames that are not late come in order of seq, so each leaves as it comes, as the late ones do.
        return frames.withColumn("emit_pos", F.col(arrival).cast("bigint"))
    by_arrival, by_seq = cuts
    f = with_late(frames, keys, seq, window, arrival, by_arrival)
    f = cut(f) if by_arrival else f
    own = [*keys, "late"]
    came = numbered(f, own, [arrival], "__n", by_arrival)
    f = numbered(f, own, [seq, arrival], "__i", by_seq)
    gone = came.where("not late").select(*keys, (F.col("__n") - window).alias("__i"), F.col(arrival).alias("__gone"))
    last = F.lit(1 << 60) + (port_order if port_order is not None else F.lit(0))
    out = f.join(gone, [*keys, "__i"], "left").withColumn("emit_pos", F.when(F.col("late"), F.col(arrival)).otherwise(F.coalesce("__gone", last)))
    return out.drop("__i", "__gone", "late")
