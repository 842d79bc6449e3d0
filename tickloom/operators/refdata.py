"""Reference data: manifests, definitions, readiness, cycles and price bounds.

manifests: keys, pos, send_ts, valid, manifest_seq, count. definitions: keys, pos, send_ts, instrument, manifest_seq, ...
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import asof, scanned, with_previous


class Manifests:
    """What a subscriber keeps of the manifests of one key, and how each new one fits it."""

    def __init__(self):
        self.seq = self.count = self.expected = None
        self.generation = 0

    def __call__(self, valid: int, seq: int, count: int) -> tuple[bool, list[str], bool, int, int | None, int | None]:
        first = self.seq is None
        ahead = 0 if first else (seq - self.seq) % 65536
        older, newer = ahead > 32768, first or 0 < ahead < 32768
        wrap = self.seq == 65535 and seq == 0
        rules = []
        if valid > 1:
            rules.append("MANIFEST.STATE_MACHINE")
        takes = False
        if valid == 1:
            if newer and ((seq == 0 and not wrap) or count == 0):
                rules.append("REFDATA.MANIFEST_SEQ_NONZERO_WHEN_VALID")
            elif older:
                rules.append("REFDATA.SEQ_MONOTONIC_NO_REGRESS")
            else:
                takes = True
                if newer and not first and ahead != 1:
                    rules.append("REFDATA.SEQ_BUMP_NOT_BY_ONE")
                if not first and ahead == 0 and count != self.count:
                    rules.append("REFDATA.COUNT_CHANGE_NO_SEQ_BUMP")
        if takes and (newer or ahead == 0):
            self.seq, self.count = seq, count
            if newer:
                self.generation, self.expected = self.generation + 1, count
        return takes, rules, takes and newer, self.generation, self.seq, self.expected


def accepted_manifests(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """Every manifest with the rules it breaks (``rules``), whether it moves the state (``accepted``) and begins a new
    set of instruments (``newer``), and the state after it: ``generation`` (the sets so far), ``current_seq`` and
    ``current_count``, which is what the set's first manifest announced.

    Acceptance depends on what was accepted before, so a key's manifests (about one a second) are scanned in order.
    valid over 1 and valid 0 move nothing; an older number (1 to 32767 behind) is discarded; number 0 that is no wrap
    from 65535, or count 0 with a newer number, is discarded; a newer number replaces the set. What a subscriber forgets
    (at a reset, or at valid 0) is said by ``keys``."""
    result = {"accepted": "boolean", "rules": "array<string>", "newer": "boolean", "generation": "bigint", "current_seq": "bigint", "current_count": "bigint"}
    return scanned(manifests, keys, "pos", ["valid", "manifest_seq", "count"], Manifests, result)


def manifest_cycles(manifests: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Accepted manifests with ``cycle`` (the retransmission cycle that is open after them) and ``closes``: the first
    manifest opens a cycle, and one that is sent ``length`` or more after the opening closes it and opens the next."""

    def make():
        start, cycle = None, 0

        def step(ts: int) -> tuple[int, bool]:
            nonlocal start, cycle
            closes = start is not None and ts >= start and ts - start >= length
            if start is None or closes:
                start, cycle = ts, cycle + 1
            return cycle, closes

        return step

    return scanned(manifests, keys, "pos", ["send_ts"], make, {"cycle": "bigint", "closes": "boolean"})


def closed_cycles(manifests: DataFrame, definitions: DataFrame, ready: DataFrame, keys: list[str], length: int) -> DataFrame:
    """The manifests that close a cycle, with established, n_expected, n_frames and missing.

    manifests: accepted ones, with generation and newer. definitions: those taken in, with generation. ready: keys,
    generation and ready_pos. What is due is the set that stood before the closing manifest, if all its instruments had
    been defined by then (established); missing counts those of it without a definition since the cycle opened, whatever
    set that came under; n_frames counts the send times that carried definitions."""
    opened = manifest_cycles(manifests, keys, length)
    ends = opened.where("closes").withColumn("set", F.col("generation") - F.col("newer").cast("bigint"))
    inside = asof(definitions.select(*keys, "generation", "instrument", "pos", "send_ts"), opened.select(*keys, "pos", "cycle"), keys, "pos", ["cycle"]).where("cycle is not null")
    before = F.lag("send_ts").over(Window.partitionBy(*keys, "cycle").orderBy("pos"))
    frames = inside.withColumn("new", F.coalesce(F.col("send_ts") != before, F.lit(True))).groupBy(*keys, "cycle").agg(F.count_if("new").alias("n_frames"))
    seen = inside.select(*keys, "cycle", "instrument").distinct().withColumn("seen", F.lit(True))
    due = ready.select(*keys, F.col("generation").alias("set"), "ready_pos")
    e = ends.withColumn("was", F.col("cycle") - 1).join(due, [*keys, "set"], "left").withColumn("established", F.coalesce(F.col("ready_pos") < F.col("pos"), F.lit(False)))
    frozen = definitions.join(due.withColumnRenamed("set", "generation"), [*keys, "generation"]).where("pos <= ready_pos").select(*keys, F.col("generation").alias("set"), "instrument").distinct()
    asked = e.where("established").select(*keys, "was", "set").join(frozen, [*keys, "set"])
    found = asked.join(seen.withColumnRenamed("cycle", "was"), [*keys, "was", "instrument"], "left").groupBy(*keys, "was").agg(F.count("*").alias("n_expected"), F.count_if(F.col("seen").isNull()).alias("missing"))
    out = e.join(found, [*keys, "was"], "left").join(frames.withColumnRenamed("cycle", "was"), [*keys, "was"], "left")
    return out.na.fill(0, ["n_expected", "missing", "n_frames"])


def cadence(rows: DataFrame, keys: list[str], order: str, ts: str, limit: int) -> DataFrame:
    """Rows whose ``ts`` lies more than ``limit`` after the one before, with the gap. Silence shows at the next row."""
    out = with_previous(rows, keys, [order], prev_ts=ts)
    return out.withColumn("gap", F.col(ts) - F.col("prev_ts")).where(F.col("gap") > limit)


def tagged(definitions: DataFrame, manifests: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions with the manifest in force (current_seq, current_count) and stale: another number than that."""
    m = manifests.select(*keys, "pos", F.col("manifest_seq").alias("current_seq"), F.col("count").alias("current_count"))
    out = asof(definitions, m, keys, "pos", ["current_seq", "current_count"])
    return out.withColumn("stale", F.coalesce(F.col("manifest_seq") != F.col("current_seq"), F.lit(False)))


def with_distinct_so_far(definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions with first_seen (the instrument's first under its number) and n_distinct so far under that number."""
    own = Window.partitionBy(*keys, "manifest_seq", "instrument").orderBy("pos")
    every = Window.partitionBy(*keys, "manifest_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = definitions.withColumn("first_seen", F.row_number().over(own) == 1)
    return out.withColumn("n_distinct", F.sum(F.col("first_seen").cast("bigint")).over(every))


def ready_at(definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, manifest_seq and the first position at which all of current_count instruments had been defined."""
    d = with_distinct_so_far(definitions, keys).where("first_seen and n_distinct = current_count")
    return d.groupBy(*keys, "manifest_seq").agg(F.min("pos").alias("ready_pos"), F.max("current_count").alias("n_defs"))


def cycles(definitions: DataFrame, expected: DataFrame, keys: list[str], ts: str, origin: str, length: int, until: DataFrame | None = None) -> DataFrame:
    """Tumbling cycles of ``length`` from each key's ``origin`` (in ``expected``: keys, origin, instrument): keys,
    cycle, n_expected, n_seen, n_times (distinct send times) and missing, for cycles with a definition; with ``until``
    (keys, last: the last time on the feed) for silent ones as well."""
    start = expected.select(*keys, origin).distinct()
    d = definitions.join(start, keys).withColumn("cycle", F.floor((F.col(ts) - F.col(origin)) / length).cast("bigint")).where("cycle >= 0")
    due = expected.groupBy(*keys).agg(F.countDistinct("instrument").alias("n_expected"))
    inside = d.join(expected.select(*keys, "instrument").distinct(), [*keys, "instrument"], "left_semi")
    seen = inside.groupBy(*keys, "cycle").agg(F.countDistinct("instrument").alias("n_seen"), F.countDistinct(ts).alias("n_times"))
    if until is not None:
        last = F.floor((F.col("last") - F.col(origin)) / length).cast("bigint")
        every = start.join(until, keys).where(F.col("last") >= F.col(origin)).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("cycle"))
        seen = every.join(seen, [*keys, "cycle"], "left").na.fill(0, ["n_seen", "n_times"])
    return seen.join(due, keys).withColumn("missing", F.col("n_expected") - F.col("n_seen"))


def surviving(trackers: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """What is kept of per-instrument state (keys, instrument) when a manifest brings a new set of instruments; channels
    without a new set keep all."""
    bumped = current.select(*keys).distinct()
    same = trackers.join(bumped, keys, "left_anti")
    return same.unionByName(trackers.join(bumped, keys, "left_semi").join(current.select(*keys, "instrument").distinct(), [*keys, "instrument"], "left_semi"))


def with_definition(facts: DataFrame, definitions: DataFrame, keys: list[str], pos: str, values: list[str], tolerance: int) -> DataFrame:
    """``facts`` with the definition in force, or where there is none yet, the first that comes within ``tolerance``
    after them; defined is "before", "after" or null."""
    before = asof(facts, definitions.select(*keys, pos, F.struct(*values).alias("__b")), keys, pos, ["__b"])
    both = asof(before, definitions.select(*keys, pos, F.struct(F.col(pos).alias("__at"), *values).alias("__a")), keys, pos, ["__a"], strict=True, forward=True)
    late = F.col("__b").isNull() & (F.col("__a.__at") <= F.col(pos) + tolerance)
    chosen = {v: F.when(F.col("__b").isNotNull(), F.col(f"__b.{v}")).when(late, F.col(f"__a.{v}")) for v in values}
    return both.withColumns(chosen).withColumn("defined", F.when(F.col("__b").isNotNull(), "before").when(late, "after")).drop("__a", "__b")


def price_bound(facts: DataFrame, price: str) -> DataFrame:
    """``facts`` (with price_bound, null where no definition is known) with status: a negative price under bound 1 or 2
    is a violation, a bound of 0 does not apply, and without a definition nothing can be said."""
    bound = F.col("price_bound")
    return facts.withColumn("status", F.when(bound.isNull(), "unverifiable").when(~bound.isin(1, 2), "na").when(F.col(price) < 0, "violation").otherwise("pass"))


def uncovered(instruments: DataFrame, snapshots: DataFrame, keys: list[str], least_cycles: int = 2) -> DataFrame:
    """Instruments of the manifest without a snapshot group, where some instrument had ``least_cycles`` of them."""
    per = snapshots.groupBy(*keys, "instrument").agg(F.count("*").alias("n"))
    ripe = per.groupBy(*keys).agg(F.max("n").alias("cycles")).where(F.col("cycles") >= least_cycles)
    return instruments.join(snapshots, [*keys, "instrument"], "left_anti").join(ripe, keys)
