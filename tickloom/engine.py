"""The whole check of a feed: datagrams in, graded findings out, as one union of relational plans.

Positions are structs (emission, era, seq, message), which order messages of all ports as a reorder buffer would let
them go. Each rule is a projection, a window on its keys or an as-of join; nothing is collected. Relations that many rules
share are written once to the checkpoint folder, so that each rule's plan is short and a lost executor costs a re-read. What cannot be decided
because something was lost, or because the run began in the middle, is unverifiable, with a reason.

Loss is one relation: at which position each port of a channel lost its first frame of an era, or began a new one. The
findings of all rules in ``GATES`` meet it in one as-of join, each by its rule's own ports.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.layout import FRAME_HEADER, MAGIC, message
from .functions.rules import RULES, starved
from .functions.storage import collected, cut, delete
from .functions.wire import decode
from .operators import frames as fr
from .operators import levels as lv
from .operators import orders as od
from .operators import refdata as rd
from .operators import snapshots as sn
from .operators.findings import graded
from .operators.ordered import Slices, asof, asof_few, asof_of_few, is_few, slices, with_common_eras, with_duplicates, with_emit_position, with_eras_of_counts, with_gaps, with_islands, with_previous, with_ring, with_sticky


@dataclass(frozen=True)
class Settings:
    """Durations are in ns, and 0 leaves out the rules that need them. ``journal`` is how many changes of an instrument
    a subscriber keeps between two snapshot groups, None if all of them. With ``empty_start`` a level book counts as known to be empty at number
    0, so that an empty first group at 0 passes; without, it has nothing to be compared with. ``slice_rows`` is how many frames
    of a channel's port and reset count are sorted in one task and, beyond, of all channels together a slice of their order
    holds; None for the defaults."""

    window: int = 8
    manifest_cadence: int = 0
    definition_cycle: int = 0
    heartbeat: int = 0
    confirm_cycles: int = 2
    ranges: tuple[tuple[int, int], ...] | None = ((1, 1023),)
    ports: tuple[str, ...] = ("mktdata", "refdata", "snapshot")
    journal: int | None = 4096
    empty_start: bool = False
    slice_rows: int | None = None

    def configured(self) -> tuple[str, ...]:
        out = []
        if self.heartbeat:
            out.append("HEARTBEAT.CADENCE")
        if self.manifest_cadence:
            out.append("REFDATA.MANIFEST_CADENCE")
        if self.definition_cycle:
            out += ["REFDATA.DEFINITION_CYCLE_COVERAGE", "REFDATA.NO_BURST_DEFINITIONS", "REFDATA.NEVER_REACHES_READY"]
        return tuple(out)


CHANNEL = ["capture_id", "channel_id"]
BOOK = [*CHANNEL, "instrument", "era_no"]
LIFE = [*BOOK, "life_no"]
PORTS = ("mktdata", "refdata", "snapshot")
_PLACE = ["capture_id", "port", "channel_id", "seq"]
SET = [*CHANNEL, "era_no", "session", "generation"]
#: Frames of a channel's port beyond which what goes over all its eras is cut into slices: windows by channel use a core each.
CHANNEL_ROWS = 500_000
#: A violation of these rules is unverifiable where one of the ports has lost a frame of the era so far.
GATES = {r: ("refdata",) for r in RULES if r.startswith("REFDATA.") or r == "MANIFEST.STATE_MACHINE"} | {
    "HEARTBEAT.CADENCE": ("mktdata",), "DELTA.PERINSTR_DENSITY": ("mktdata",), "DELTA.PERINSTR_DUP_DIVERGENT": ("mktdata",), "TRADE.EXEC_GROUPING": ("mktdata",),
    "RESET.SNAPSHOT_FOLLOWS": ("mktdata", "snapshot"), "RESET.RECOVERY_SNAPSHOT_ANCHOR_MATCHES_RESET": ("mktdata",),
    "RESET.NO_DANGLING_DELTAS_AT_OR_BELOW_ANCHOR": ("mktdata",), "SNAP.ROUND_ROBIN_COVERS_MANIFEST": ("snapshot",),
}
#: Rules that say nothing of a run before it has seen a frame of the port.
NEEDS = {"RESET.SNAPSHOT_FOLLOWS": "snapshot"}
#: The rules on what follows an instrument reset.
RECOVERED = ("RESET.SNAPSHOT_FOLLOWS", "RESET.RECOVERY_SNAPSHOT_ANCHOR_MATCHES_RESET", "RESET.NO_DANGLING_DELTAS_AT_OR_BELOW_ANCHOR")
_PRUNED = 1 << 32  # lives after a pruning are numbered from a multiple of this
_CARRIED = ("capture_id", "port", "channel_id", "seq", "era_no", "pos", "send_ts", "dirty", "lost_frames", "future", "body")


_POS = ("emit_pos", "era_no", "seq", "msg_index")
_POS_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in _POS) + ">"


def _say(rows: DataFrame, rule: str | Column, status: str | Column = "violation", reason: str | Column | None = None, detail: Column | None = None) -> DataFrame:
    """Rows as findings; a missing place is filled with what a finding without one carries."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    has = lambda c, default: c if c in rows.columns else default
    placed = "pos" in rows.columns and "msg_index" in getattr(rows.schema["pos"].dataType, "names", [])
    pos = "if(pos is null, null, struct(" + ", ".join(f"cast(pos.{c} as bigint) as {c}" for c in _POS) + "))" if placed else f"cast(null as {_POS_TYPE})"
    rest = [
        "capture_id", f"{has('port', repr('snapshot'))} as port", "cast(channel_id as bigint) as channel_id", f"cast({has('instrument', '0')} as bigint) as instrument",
        f"cast({has('seq', 'null')} as bigint) as seq", f"{has('future', 'false')} as future", f"{pos} as pos",
    ]
    return rows.select(as_column(rule).alias("rule_id"), as_column(status).alias("status"), as_column(reason).alias("reason"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"), *map(F.expr, rest))


@contextmanager
def _tasks(spark: SparkSession, n: int | None) -> Iterator[None]:
    """Shuffles of ``n`` tasks inside, if given."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    try:
        if n:
            spark.conf.set(name, str(n))
        yield
    finally:
        spark.conf.set(name, was)


class Run:
    """The relations of one run, built once and shared by the rules."""

    def __init__(self, datagrams: DataFrame, feed: str, settings: Settings = Settings(), rules: Collection[str] | None = None):
        self.feed, self.settings, self.rules = feed, settings, rules
        self.views: dict[tuple[str, str | None], DataFrame] = {}
        frames = fr.decode_frames(datagrams, feed).withColumn("future", F.col("schema_version") > fr.SCHEMA_VERSION[feed])
        self.frames = cut(frames if self.asked(*fr.WALKED) else frames.drop("findings"))
        own = (F.octet_length("raw") >= FRAME_HEADER) & (F.col("magic") == MAGIC[feed])
        keys = [*CHANNEL, "port"]
        # Slices of an era's order, where one is long, and of a channel's, which may be long by many eras.
        self.cuts, by_seq = slices(self.frames.where(own), [*keys, "reset_count"], "arrival", "seq", size=settings.slice_rows)
        self.channel_cuts = self.cuts or slices(self.frames.where(own), keys, "arrival", size=settings.slice_rows, key_rows=CHANNEL_ROWS)[0]
        with _tasks(datagrams.sparkSession, self.channel_cuts and self.channel_cuts.tasks):
            self._sequence(own, keys, by_seq)

    def _sequence(self, own: Column, keys: list[str], by_seq: Slices | None) -> None:
        settings, feed = self.settings, self.feed
        eras = with_eras_of_counts(self.frames.where(own), CHANNEL, "port")
        if eras is None:
            eras = cut(with_common_eras(self.frames.where(own), CHANNEL, "port", cuts=self.channel_cuts))
        self.lost_eras = eras.where("era_state in ('older', 'ambiguous')")
        self.starts = eras.where("era_state = 'newer'")
        current = eras.where("era_state in ('same', 'newer')")
        if settings.window or not self._sequence_once(current, [*keys, "era_no"]):
            copies = cut(with_duplicates(current.withColumn("payload", F.xxhash64("raw")), [*keys, "era_no", "seq"], "payload"))
            self.copies = copies.where("copy_no > 0")
            order = F.when(F.col("port") == "mktdata", 0).when(F.col("port") == "refdata", 1).otherwise(2)
            once = with_emit_position(copies.where("copy_no = 0"), [*keys, "era_no"], window=settings.window, port_order=order, cuts=(self.cuts, by_seq))
            once = once.withColumn("pos", F.struct("emit_pos", "era_no", "seq"))
            self.accepted = self._gapped(cut(once) if self.cuts else once, [*keys, "era_no"], ["pos"])
        m = fr.messages_of(self.accepted.drop("pos"))
        m = m.drop("magic", "schema_version", "msg_count", "frame_length", "reset_count", "era_state", "payload", "copy_no", "divergent", "prev_max", "backward")
        self.messages = cut(m.withColumn("pos", F.struct("emit_pos", "era_no", "seq", "msg_index")))

    def _gapped(self, once: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        """Frames without copies, with the columns of ``with_gaps`` and dirty; written."""
        if not self.cuts:
            return cut(with_sticky(with_gaps(once, keys, "seq", order), keys, F.col("missing") > 0, order))
        gaps = cut(with_gaps(once, keys, "seq", order, self.cuts))
        first = cut(gaps.where("missing > 0").groupBy(*keys).agg(F.min("pos").alias("__first")))
        dirty = F.coalesce(F.col("pos") >= F.col("__first"), F.lit(False))
        return gaps.join(F.broadcast(first), keys, "left").withColumn("dirty", dirty).drop("__first")

    def _sequence_once(self, current: DataFrame, keys: list[str]) -> bool:
        """Without a reorder buffer frames go on as they come. A copy is never beyond the greatest seq before it: where every
        frame is, there are none to be looked for, and one sort is all. False where one is not."""
        once = with_emit_position(current, keys, window=0).withColumn("pos", F.struct("emit_pos", "era_no", "seq"))
        self.accepted = self._gapped(once, keys, ["arrival", "seq"])
        self.copies = self.accepted.where("false").withColumns({"copy_no": F.lit(1), "divergent": F.lit(False)})
        return self.accepted.where("seq <= prev_max").isEmpty()

    def asked(self, *rules: str) -> bool:
        """Whether findings of any of ``rules`` are wanted."""
        return self.rules is None or any(r in self.rules for r in rules)

    def say(self, rows: DataFrame, rule: str | Column, *rest, **more) -> DataFrame | None:
        """Rows as findings (``_say``), of the rules that are asked for; None where they are of another rule."""
        if isinstance(rule, str):
            return _say(rows, rule, *rest, **more) if self.asked(rule) else None
        found = _say(rows, rule, *rest, **more)
        return found if self.rules is None else found.where(F.col("rule_id").isin(*self.rules))

    def loss_gate(self) -> DataFrame:
        """Positions at which a port of a channel begins an era or loses its first frame of it, and lost_<port> after
        each: null while no frame of the port has come."""
        at = F.struct(*(F.col(f"pos.{c}").cast("bigint").alias(c) for c in _POS[:3]), F.lit(-1).cast("bigint").alias("msg_index"))
        first = self.accepted.groupBy(*CHANNEL, "port", "era_no").agg(F.min(at).alias("begins"), F.min(F.when(F.col("dirty"), at)).alias("loses"))
        flips = F.array(F.struct(F.col("begins").alias("pos"), F.lit(False).alias("lost")), F.struct(F.col("loses").alias("pos"), F.lit(True).alias("lost")))
        flips = first.select(*CHANNEL, "port", F.inline(flips)).where("pos is not null")
        until = Window.partitionBy(*CHANNEL).orderBy("pos", "lost").rowsBetween(Window.unboundedPreceding, 0)
        return flips.select(*CHANNEL, "pos", *(F.last(F.when(F.col("port") == p, F.col("lost")), ignorenulls=True).over(until).alias(f"lost_{p}") for p in PORTS))

    def gated(self, findings: DataFrame, gate: DataFrame) -> DataFrame:
        """``findings`` with what loss leaves of them; those without a position are of the end of the run."""
        ruled = F.col("rule_id").isin(*GATES)
        end = F.struct(*(F.lit((1 << 63) - 1).alias(c) for c in _POS))
        rows = findings.where(ruled).withColumn("pos", F.coalesce("pos", end))
        rows = asof(rows, gate, CHANNEL, "pos", [f"lost_{p}" for p in PORTS], cuts=self.channel_cuts)
        lost, unseen = F.lit(False), F.lit(False)
        for port in PORTS:
            lost = lost | (F.col("rule_id").isin(*(r for r, ports in GATES.items() if port in ports), "") & F.coalesce(f"lost_{port}", F.lit(False)))
            unseen = unseen | (F.col("rule_id").isin(*(r for r, p in NEEDS.items() if p == port), "") & F.col(f"lost_{port}").isNull())
        bad = F.col("status") == "violation"
        status = F.when(bad & unseen, "na").when(bad & lost, "unverifiable").otherwise(F.col("status"))
        rows = rows.withColumn("reason", F.when(bad & lost & ~unseen, "loss").otherwise(F.col("reason"))).withColumn("status", status)
        return rows.select(*findings.columns).unionByName(findings.where(~ruled)).drop("pos")

    def typed(self, *names: str, port: str | None = None) -> list[DataFrame]:
        keep = ("capture_id", "port", "channel_id", "seq", "era_no", "pos", "send_ts", "dirty", "missing", "future", "type", "body")
        m = self.messages.where(f"port = '{port}'") if port else self.messages
        m = m.withColumnRenamed("missing", "lost_frames")
        for n in names:
            if (n, port) not in self.views:
                self.views[n, port] = decode(m, message(self.feed, n), tuple("lost_frames" if c == "missing" else c for c in keep)).drop("channel", "ts")
        return [self.views[n, port] for n in names]

    # --- envelope and sequencing

    def envelope(self) -> list[DataFrame | None]:
        a, keys = self.accepted, [*CHANNEL, "port", "era_no"]
        walked = fr.frame_findings(self.frames).where("not transport") if self.asked(*fr.WALKED) else None
        out = [
            walked and self.say(walked, F.col("rule_id"), "violation", None, F.col("detail")),
            fr.structural(self.messages, self.feed, self.settings.ranges, self.rules).transform(lambda f: self.say(f, F.col("rule_id"), F.col("status"))),
            self.say(self.copies.where("divergent"), "FRAME.SEQ_DUP_DIVERGENT"),
            self.say(a.where("backward"), "FRAME.SEQ_RESET_GAP"),
            self.say(with_previous(a.where("not backward"), keys, ["pos"], self.cuts, before="send_ts").where("send_ts < before"), "FRAME.SEND_TS_MONOTONIC"),
        ]
        if self.feed == "mbo":
            out.append(self.say(self.starts.where("port = 'mktdata' and seq <> 0"), "FRAME.MKTDATA_SEQ_START"))
        if self.settings.heartbeat:
            beats = self.typed("heartbeat", port="mktdata")[0].groupBy("capture_id", "port", "channel_id", "seq", "era_no", "send_ts").agg(F.min("pos").alias("pos"))
            out.append(self.say(rd.cadence(beats, CHANNEL, "pos", "send_ts", self.settings.heartbeat), "HEARTBEAT.CADENCE"))
        return out

    def transport(self) -> DataFrame:
        """capture_id, port, kind (loss or corruption), rule_id: what the way from the publisher did. Of runs that work out
        the rules of ``frames.WALKED``."""
        loss = self.accepted.where("missing > 0").select("capture_id", "port", F.lit("loss").alias("kind"), F.lit(None).cast("string").alias("rule_id"))
        old = self.lost_eras.select("capture_id", "port", F.lit("loss").alias("kind"), F.lit(None).cast("string").alias("rule_id"))
        bad = fr.frame_findings(self.frames).where("transport").select("capture_id", "port", F.lit("corruption").alias("kind"), "rule_id")
        return loss.unionByName(old).unionByName(bad)

    # --- reference data

    def reference(self) -> list[DataFrame | None]:
        """What a subscriber keeps of reference data ends at a reset and at a manifest that says it is not valid (a new
        session), and its set of instruments at every newer manifest (a new generation)."""
        cfg = self.settings
        m, d = self.typed("manifest", "definition", port="refdata")
        keys = [*CHANNEL, "era_no", "session"]
        m = with_islands(m, [*CHANNEL, "era_no"], F.col("valid") == 0, ["pos"], "session")
        every = self.every_manifest = cut(rd.accepted_manifests(m, keys))
        manifests = every.where("accepted")
        states = every.where("accepted or valid = 0").withColumn("serving", F.col("valid") == 1)
        tagged = asof(d, states, [*CHANNEL, "era_no"], "pos", ["session", "generation", "current_seq", "current_count", "serving"]).where("serving")
        tagged = cut(tagged.withColumn("stale", F.col("manifest_seq") != F.col("current_seq")))
        self.definitions = tagged.where("not stale")
        # Reference data that is little goes to all tasks, so that what it is joined with need not be sorted.
        self.few_sets = is_few(tagged)
        seen = rd.with_distinct_so_far(self.definitions, SET)
        self.ready = cut(rd.ready_at(self.definitions, SET))
        opens = self.accepted.where("port = 'refdata'").groupBy(*CHANNEL, "era_no").agg(F.min("pos").alias("p"))
        opens = opens.select(*CHANNEL, "era_no", F.struct("p.emit_pos", "p.era_no", "p.seq", F.lit(-1).cast(m.schema["pos"].dataType["msg_index"].dataType).alias("msg_index")).alias("pos"), F.lit(False).alias("serving"))
        # Where the set in force changes: facts of any port are judged by the one before their position.
        self.sets = states.where("newer or not serving").select(*SET, "pos", "serving").unionByName(opens, allowMissingColumns=True)
        r = self.ready.select(*SET, "ready_pos")
        was = asof(every.where("valid = 0").withColumn("session", F.col("session") - 1), self.ready.select(*keys, F.col("ready_pos").alias("pos"), "n_defs"), keys, "pos", ["n_defs"])
        empty = asof(manifests.where("count = 0 and not newer"), self.ready.select(*keys, F.col("ready_pos").alias("pos"), "n_defs"), keys, "pos", ["n_defs"])
        out = [
            self.say(every.withColumn("rule", F.explode("rules")), F.col("rule")),
            self.say(tagged.where("stale"), "REFDATA.STALE_SEQ_TAG_AFTER_BUMP"),
            self.say(seen.where("first_seen and n_distinct > current_count"), "REFDATA.COUNT_VS_DISTINCT_DEFS"),
            self.say(seen.where("first_seen").join(r, SET).where("pos > ready_pos"), "REFDATA.SET_CHANGE_NO_SEQ_BUMP"),
            self.say(was.where("n_defs is not null"), "REFDATA.VALID_FLAG_WHILE_SERVING"),
            self.say(empty.where("n_defs is not null"), "MANIFEST.STATE_MACHINE"),
        ]
        if cfg.manifest_cadence:
            out.append(self.say(rd.cadence(manifests, keys, "pos", "send_ts", cfg.manifest_cadence), "REFDATA.MANIFEST_CADENCE"))
        if cfg.definition_cycle:
            c = cut(rd.closed_cycles(manifests, self.definitions, self.ready, keys, cfg.definition_cycle))
            cold = ~F.col("established")
            covered = F.when(cold, "unverifiable").when(F.col("missing") > 0, "violation").otherwise("pass")
            out.append(self.say(c, "REFDATA.DEFINITION_CYCLE_COVERAGE", covered, F.when(cold, "cold_start")))
            paced = F.when(cold | (F.col("missing") > 0), "unverifiable").when(F.col("n_expected") <= 1, "na").when(F.col("n_frames") == 1, "violation").otherwise("pass")
            out.append(self.say(c, "REFDATA.NO_BURST_DEFINITIONS", paced, F.when(cold, "cold_start").when(F.col("missing") > 0, "superseded")))
            if cfg.manifest_cadence:
                out.append(self._never_ready(every, manifests, d))
        return out

    def _never_ready(self, every: DataFrame, manifests: DataFrame, definitions: DataFrame) -> DataFrame:
        """One finding for each channel that reference data came of, by its last session."""
        last = F.max(F.struct("era_no", "session"))
        seen = every.select(*CHANNEL, "era_no", "session").unionByName(definitions.select(*CHANNEL, "era_no", F.lit(-1).cast("bigint").alias("session")))
        now = seen.groupBy(*CHANNEL).agg(last.alias("now")).select(*CHANNEL, "now.*")
        keys = [*CHANNEL, "era_no", "session"]
        span = manifests.groupBy(*keys).agg(F.min_by("send_ts", "pos").alias("first_ts"), F.max_by("send_ts", "pos").alias("last_ts"))
        s = now.join(span, keys, "left").join(self.ready.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").withColumn("port", F.lit("refdata"))
        short = F.col("last_ts") - F.col("first_ts") < self.settings.manifest_cadence + self.settings.definition_cycle
        v = sn.verdict([
            (F.col("n").isNotNull(), "pass", None), (F.col("first_ts").isNull(), "unverifiable", "cold_start"), (F.col("last_ts") < F.col("first_ts"), "unverifiable", "superseded"),
            (short, "unverifiable", "insufficient_window"), (F.lit(True), "violation", None),
        ])
        s = s.withColumn("v", v)
        return self.say(s, "REFDATA.NEVER_REACHES_READY", F.col("v.status"), F.col("v.reason"))

    def known(self, facts: DataFrame, *fields: str) -> DataFrame:
        """``facts`` with channel_ready and, of the instrument's definition in the set in force, known and the fields."""
        own = {"era_no": "ref_era", "session": "session", "generation": "generation"}
        named = lambda rows: rows.withColumnsRenamed({"era_no": "ref_era"})
        f = asof(facts, named(self.sets), CHANNEL, "pos", [*own.values(), "serving"], cuts=self.channel_cuts)
        keys = [*CHANNEL, *own.values()]
        f = asof(f, named(self.definitions.select(*SET, "instrument", "pos", F.lit(True).alias("known"), *fields)), [*keys, "instrument"], "pos", ["known", *fields])
        f = asof(f, named(self.ready.select(*SET, F.col("ready_pos").alias("pos"), F.lit(True).alias("channel_ready"))), keys, "pos", ["channel_ready"], cuts=self.channel_cuts)
        off = ~F.coalesce("serving", F.lit(False))
        return f.withColumns({c: F.when(~off, F.col(c)) for c in ("known", "channel_ready", *fields)}).drop(*own.values(), "serving")

    # --- feeds

    def top_of_book(self) -> list[DataFrame | None]:
        facts = reduce(DataFrame.unionByName, [t.select(*_PLACE, "pos", "instrument", "future") for t in self.typed("quote", "trade", port="mktdata")])
        k = self.known(facts)
        status = F.when(F.col("channel_ready").isNull(), "na").when(F.col("known"), "pass").otherwise("violation")
        return [self.say(k, "TOB.QUOTE.REFDATA_KNOWN", status)]

    def midpoint(self) -> list[DataFrame | None]:
        k = self.known(self.typed("midpoint", port="mktdata")[0].select(*_PLACE, "pos", "instrument", "method", "mid_price", "future"), "default_method", "price_bound")
        ready = F.col("channel_ready").isNotNull() & F.col("known").isNotNull()
        default = F.when((F.col("method") != 0) | ~ready, "na").when(F.col("default_method") == 0, "violation").otherwise("pass")
        bound = F.when(~ready | ~F.col("price_bound").isin(1, 2), "na").when(F.col("mid_price") < 0, "violation").otherwise("pass")
        return [self.say(k, "MID.METHOD0_REQUIRES_DEFAULT", default), self.say(k, "MID.PRICE_BOUND", bound)]

    def _pruned(self, rows: DataFrame) -> DataFrame:
        """``rows`` with pruned: how many complete sets of instruments left theirs out so far. Order books of instruments
        that a set leaves out are forgotten when its last definition has come."""
        keys = [*CHANNEL, "instrument"]
        numbered = lambda events, by, name: events.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("pos")).cast("bigint"))
        frozen = self.ready.select(*SET, "ready_pos")
        kept = self.definitions.select(*SET, "instrument", "pos").join(frozen, SET).where("pos <= ready_pos").select(*keys, F.col("ready_pos").alias("pos")).distinct()
        sets, kept = numbered(frozen.select(*CHANNEL, F.col("ready_pos").alias("pos")), CHANNEL, "n_sets"), numbered(kept, keys, "n_kept")
        if self.few_sets:
            out = asof_few(asof_few(rows, sets, CHANNEL, "pos", ["n_sets"]), kept, keys, "pos", ["n_kept"])
        else:
            out = asof(rows, sets, CHANNEL, "pos", ["n_sets"], cuts=self.channel_cuts)
            out = asof(out, kept, keys, "pos", ["n_kept"])
        return out.withColumn("pruned", F.coalesce("n_sets", F.lit(0)) - F.coalesce("n_kept", F.lit(0))).drop("n_sets", "n_kept")

    def _lives(self, rows: DataFrame) -> DataFrame:
        """``rows`` with life_no, the instrument resets so far: after a reset the book is empty and numbers start anew.
        Lives of an order book that a set of instruments left out are numbered from the next multiple of ``_PRUNED``."""
        (resets,) = self.typed("instrument_reset", port="mktdata")
        few = getattr(self, "few_resets", None)
        if few is None:
            few = self.few_resets = is_few(resets)
        if few:
            own = [*BOOK, "pruned"] if self.feed == "mbo" else BOOK
            pruned = self._pruned if self.feed == "mbo" else lambda r: r
            begun = pruned(resets.select(*_PLACE, "era_no", "pos", "instrument"))
            begun = begun.withColumn("life_no", F.row_number().over(Window.partitionBy(*own).orderBy("pos")).cast("bigint"))
            out = asof_few(pruned(rows), begun, own, "pos", ["life_no"]).withColumn("life_no", F.coalesce("life_no", F.lit(0).cast("bigint")))
            return out.withColumn("life_no", F.col("pruned") * _PRUNED + F.col("life_no")).drop("pruned") if self.feed == "mbo" else out
        both = rows.withColumn("is_reset", F.lit(False)).unionByName(resets.select(*_PLACE, "era_no", "pos", "instrument").withColumn("is_reset", F.lit(True)), allowMissingColumns=True)
        if self.feed != "mbo":
            return with_islands(both, BOOK, F.col("is_reset"), ["pos"], "life_no").where("not is_reset").drop("is_reset")
        both = with_islands(self._pruned(both), [*BOOK, "pruned"], F.col("is_reset"), ["pos"], "life_no").where("not is_reset")
        return both.withColumn("life_no", F.col("pruned") * _PRUNED + F.col("life_no")).drop("is_reset", "pruned")

    def _sequenced(self, deltas: DataFrame) -> DataFrame:
        """Deltas with life_no, prev_max, missing and untrusted: something before this row is missing, or the numbering
        was not seen from 1."""
        g = with_gaps(self._lives(deltas), LIFE, "per_seq", ["pos"])
        broken = (F.col("missing") > 0) | (F.col("prev_max").isNull() & (F.col("per_seq") != 1))
        g = with_sticky(g, LIFE, broken, ["pos"], "broken")
        g = with_sticky(g, LIFE, F.coalesce(F.col("per_seq") <= F.col("prev_max"), F.lit(False)), ["pos"], "repeated")
        return cut(with_sticky(g, LIFE, F.col("broken") | F.coalesce(F.col("dirty"), F.lit(False)), ["pos"], "untrusted"))

    def _groups(self, row: str, key: Column, *values: str) -> DataFrame:
        """Snapshot groups, with the life of their instrument at their end. A group is dirty if the snapshot port lost a
        frame between its begin and its end; what was lost before its begin doesn't touch it."""
        begins, rows, ends = self.typed("snapshot_begin", row, "snapshot_end", port="snapshot")
        common = ["capture_id", "port", "channel_id", "seq", "era_no", "pos", "snapshot_id", "lost_frames", "dirty"]
        b = begins.select(*common, "instrument", F.col("anchor").cast("bigint").alias("anchor"), "total", "last_seq").withColumn("kind", F.lit("begin"))
        e = ends.select(*common, "instrument", F.col("anchor").cast("bigint").alias("anchor")).withColumn("kind", F.lit("end"))
        r = rows.select(*common, key.alias("key"), *(F.col(v).cast("bigint").alias(v) for v in values)).withColumn("kind", F.lit("row"))
        every = b.unionByName(r, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)
        after = F.lead("before").over(Window.partitionBy(*CHANNEL, "era_no").orderBy("island"))
        tainted = F.col("torn") | (F.col("end_pos").isNull() & F.coalesce(after > 0, F.lit(False)))
        if is_few(b):
            keys = [*CHANNEL, "era_no"]
            numbers = b.select(*keys, "pos", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).cast("bigint").alias("island"))
            self.snapshot_rows = cut(asof_few(every, numbers, keys, "pos", ["island"]).withColumn("island", F.coalesce("island", F.lit(0).cast("bigint"))))
            g = sn.few_groups(self.snapshot_rows, keys).withColumn("dirty", tainted).drop("torn", "before").where("island > 0").withColumn("port", F.lit("snapshot"))
            return cut(self._lives(g.withColumn("pos", F.coalesce("end_pos", "begin_pos"))).withColumn("pos", F.col("begin_pos")))
        at, tasks = (F.col("pos.emit_pos"), self.cuts.tasks) if self.cuts else (None, None)
        self.snapshot_rows = cut(with_islands(every, [*CHANNEL, "era_no"], F.col("kind") == "begin", ["pos"], at=at, tasks=tasks))
        g = sn.groups(self.snapshot_rows, [*CHANNEL, "era_no"]).where("island > 0")
        # A frame after a loss taints the group that was open before it: not the one that it begins.
        first = F.min_by("seq", "pos").over(Window.partitionBy(*CHANNEL, "era_no", "island"))
        more = self.snapshot_rows.withColumn("inside", F.col("seq") > first).groupBy(*CHANNEL, "era_no", "island").agg(
            F.max("last_seq").alias("last_seq"), F.max(F.col("inside") & (F.col("lost_frames") > 0)).alias("torn"), F.max(F.when(F.col("kind") == "end", F.col("pos"))).alias("end_pos"),
            F.min("seq").alias("seq"), F.max(F.coalesce("dirty", F.lit(False))).alias("port_dirty"), F.max(F.col("lost_frames") * F.when(F.col("kind") == "begin", 1).otherwise(0)).alias("before"),
        )
        more = more.withColumn("dirty", tainted).drop("torn", "before")
        g = g.join(more, [*CHANNEL, "era_no", "island"]).withColumn("port", F.lit("snapshot"))
        return cut(self._lives(g.withColumn("pos", F.coalesce("end_pos", "begin_pos"))).withColumn("pos", F.col("begin_pos")))

    def _structure(self, g: DataFrame) -> dict[str, Column]:
        return {
            "open": (F.col("orphans") > 0) | ~F.col("ended"), "count": F.col("ended") & (F.col("total") != F.col("received")), "end": F.col("end_differs"),
            "id": F.col("wrong_id") > 0, "dup": F.col("duplicates") > 0, "empty": (F.col("total") == 0) & (F.col("received") > 0),
        }

    def market_by_price(self) -> list[DataFrame | None]:
        updates, clears = self.typed("level_update", "book_clear", port="mktdata")
        common = [*_PLACE, "era_no", "pos", "dirty", "instrument", "per_seq"]
        u = updates.select(*common, "side", "price", F.col("qty").cast("bigint").alias("qty"), "action")
        c = clears.select(*common, "clear_side", "scope", "from_price")
        s = self._lives(u.select(*common).unionByName(c.select(*common)))
        g = self._groups("snapshot_level", F.concat_ws(":", "side", "price"), "side", "price", "qty")
        shape = self._structure(g)
        bad = shape["count"] | shape["end"] | shape["id"] | shape["dup"]
        structure = sn.verdict([(F.col("dirty") & (bad | shape["open"]), "unverifiable", "loss"), (~F.col("ended"), "unverifiable", "truncated"), (bad | shape["open"], "violation", None)])
        g = g.withColumn("structure", structure)
        out = [
            self.say(lv.absolute_apply(u), "MBP.DELTA.ABSOLUTE_APPLY"),
            self.say(lv.malformed_clears(c), "MBP.DELTA.ABSOLUTE_APPLY"),
            self.say(g, "MBP.SNAP.GROUP_STRUCTURE", F.col("structure.status"), F.col("structure.reason")),
        ]
        done = g.where("structure.status = 'pass'").withColumn("k", F.col("last_seq"))
        n = self._adopted(s, c, done)
        out.append(self.say(n.where("not adopted and missing > 0"), "MBP.DELTA.PERINSTR_DENSITY"))
        out.append(self.say(n.where("restarts"), "MBP.DELTA.PERINSTR_NO_SNAPSHOT_RESET"))
        audits = n.where("adopted")
        compared = audits.where("base_k is not null and k >= base_k").select(*LIFE, "island", "k", "base_island")
        # What stands at a group's number: the base's levels, and the accepted changes since, each of which belongs to the
        # first group that reaches its number.
        levels = self.snapshot_rows.where("kind = 'row'").select(*CHANNEL, "era_no", "island", "side", "price", "qty")
        base = compared.join(levels.withColumnRenamed("island", "base_island"), [*CHANNEL, "era_no", "base_island"])
        base = base.select(*LIFE, "island", F.lit(-1).cast("bigint").alias("per_seq"), "side", "price", "qty")
        changes = u.select(*common, "side", "price", "qty").unionByName(c.join(lv.malformed_clears(c).select(*BOOK, "pos"), [*BOOK, "pos"], "left_anti").select(*common, "clear_side", "scope", "from_price"), allowMissingColumns=True)
        taken = n.where("not adopted and accepted").select(*LIFE, "pos")
        changes = changes.join(taken, [*BOOK, "pos"]).withColumn("at", F.col("per_seq").cast("bigint"))
        reach = audits.where("base_k is null or k > base_k").select(*LIFE, F.col("k").cast("bigint").alias("at"), "island")
        changes = asof(changes, reach, LIFE, "at", ["island"], forward=True).where("island is not null")
        keys = [*LIFE, "island"]
        changes = changes.join(compared.select(*keys), keys, "left_semi")
        book = lv.ladder(base.unionByName(changes.where("price is not null").select(*base.columns)), keys, changes.where("scope is not null"))
        snap = levels.join(compared.select(*keys), [*CHANNEL, "era_no", "island"]).select(*keys, "side", "price", "qty")
        diff = sn.signatures(sn.book_diff(snap, book, keys, ["side", "price"], ["qty"]), keys, ["side", "price"])
        audits = audits.join(diff.select(*keys, "signature", "shown"), keys, "left")
        v = sn.verdict(
            [
                (F.col("gapped"), "unverifiable", "loss"),
                (F.col("overflow"), "unverifiable", "overflow"),
                (F.col("base_k").isNull() & ((F.col("k") > 0) | (F.col("received") > 0) | F.lit(not self.settings.empty_start)), "unverifiable", "cold_start"),
                (F.col("k") < F.col("base_k"), "unverifiable", "reorder"),
                (F.col("k") > F.coalesce("prev_max", F.lit(0)), "unverifiable", "pending"),
                (F.col("signature").isNotNull(), "violation", None),
            ]
        )
        audits = audits.withColumn("v", v).withColumn("pos", F.col("begin_pos"))
        out.append(self.say(audits, "MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", F.col("v.status"), F.col("v.reason"), F.col("shown")))
        return out

    def _adopted(self, s: DataFrame, clears: DataFrame, done: DataFrame) -> DataFrame:
        """Deltas and, at their ends, the groups that a subscriber adopts, in one numbering per life. A group sets the
        number to its own if that is greater, and ends what the deltas before it missed. Columns of both: prev_max (the
        number before), missing, accepted, restarts. Of groups: gapped and overflow since the group before, and the
        base, which is the group adopted before with the greatest number (base_k, base_island)."""
        bad = lv.malformed_clears(clears).select(*BOOK, "pos", F.lit(True).alias("malformed"))
        d = s.select(*_PLACE, "era_no", "instrument", "life_no", "pos", "per_seq").join(bad, [*BOOK, "pos"], "left").withColumn("adopted", F.lit(False))
        a = done.select(*_PLACE, "era_no", "instrument", "life_no", F.col("end_pos").alias("pos"), "begin_pos", "island", "k", "received").withColumn("adopted", F.lit(True))
        n = d.unionByName(a, allowMissingColumns=True)
        w = Window.partitionBy(*LIFE).orderBy("pos")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        n = n.withColumn("prev_max", F.max(F.coalesce("per_seq", F.when(F.col("k") > 0, F.col("k")))).over(before)).withColumn("after_group", F.lag("adopted").over(w))
        n = n.withColumn("missing", F.greatest(F.coalesce(F.col("per_seq") - F.col("prev_max") - 1, F.lit(0)), F.lit(0)).cast("bigint"))
        n = n.withColumn("accepted", ~F.col("adopted") & (F.col("prev_max").isNull() | (F.col("per_seq") > F.col("prev_max"))))
        n = n.withColumn("restarts", F.coalesce(F.col("after_group") & (F.col("per_seq") == 1) & (F.col("prev_max") > 1), F.lit(False)))
        n = n.withColumn("span", F.coalesce(F.sum(F.col("adopted").cast("bigint")).over(before), F.lit(0)))
        part = Window.partitionBy(*LIFE, "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        n = n.withColumn("gapped", F.max((F.col("missing") > 0) | F.col("restarts") | F.coalesce("malformed", F.lit(False))).over(part))
        n = n.withColumn("taken", F.sum(F.col("accepted").cast("bigint")).over(part))
        n = n.withColumn("base", F.max(F.when(F.col("adopted"), F.struct(F.col("k"), F.col("pos"), F.col("island")))).over(before))
        kept = F.greatest(F.col("prev_max") - F.col("k"), F.lit(0))  # changes beyond a group's number stay in the journal
        n = n.withColumn("kept", F.coalesce(F.max(F.when(F.col("adopted"), F.struct("pos", kept.alias("kept")))).over(before)["kept"], F.lit(0)))
        most = self.settings.journal
        n = n.withColumn("overflow", F.lit(False) if most is None else F.col("kept") + F.col("taken") > most)
        return cut(n.withColumn("base_k", F.col("base.k")).withColumn("base_island", F.col("base.island")).drop("base", "kept", "taken", "span", "after_group"))

    def market_by_order(self) -> list[DataFrame | None]:
        adds, cancels, executes, trades = self.typed("order_add", "order_cancel", "order_execute", "trade", port="mktdata")
        common = [*_PLACE, "era_no", "pos", "dirty", "instrument", "source", "per_seq", "order_id"]
        qty = F.col("qty").cast("bigint").alias("qty")
        events = (
            adds.select(*common, "side", "price", "flags", F.col("enter_ts").cast("bigint").alias("enter_ts"), qty, F.xxhash64(*adds.drop(*_CARRIED).columns).alias("payload")).withColumn("kind", F.lit("add"))
            .unionByName(cancels.select(*common, F.xxhash64(*cancels.drop(*_CARRIED).columns).alias("payload")).withColumn("kind", F.lit("cancel")), allowMissingColumns=True)
            .unionByName(executes.select(*common, "aggressor", "trade_id", "price", qty, (F.col("exec_flags").bitwiseAND(F.lit(1).cast("bigint")) != 0).alias("full_fill"), F.xxhash64(*executes.drop(*_CARRIED).columns).alias("payload")).withColumn("kind", F.lit("execute")), allowMissingColumns=True)
        )
        s = self._sequenced(events if self.asked("DELTA.PERINSTR_DUP_DIVERGENT") else events.withColumn("payload", F.lit(None).cast("bigint")))
        hidden = s.where((F.col("kind") == "add") & (F.col("flags").bitwiseAND(F.lit(4).cast("bigint")) != 0)).select(*BOOK, "order_id").distinct()
        life = LIFE
        loss = F.coalesce(F.col("dirty"), F.lit(False))
        first = s.where("prev_max is null and per_seq <> 1")
        fresh = F.col("life_no") % _PRUNED == 0  # no reset seen
        repeats = with_ring(s, life, "per_seq", ["pos"], "payload", 16)
        (batches, resets) = self.typed("batch_boundary", "instrument_reset", port="mktdata")
        out = [
            self.say(s.where("missing > 0"), "DELTA.PERINSTR_DENSITY"),
            self.say(first, "DELTA.PERINSTR_FIRST_VALUE", F.when(~fresh & ~loss, "violation").otherwise("unverifiable"), F.when(loss, "loss").when(fresh, "cold_start")),
            self.say(s.where("per_seq = 1 and prev_max > 1"), "DELTA.PERINSTR_NO_SNAPSHOT_RESET"),
            self.say(repeats.where("divergent"), "DELTA.PERINSTR_DUP_DIVERGENT"),
            self.say(s.where("prev_max = 4294967295 and per_seq = 0"), "DELTA.PERINSTR_WRAP_BEFORE_RESET"),
            self.say(with_previous(batches, [*CHANNEL, "era_no"], ["pos"], self.cuts, before="batch_id").where("batch_id < before"), "BATCH.ID_MONOTONIC"),
        ]
        seen = s if hidden.isEmpty() else s.join(hidden, [*BOOK, "order_id"], "left_anti")
        lives = cut(od.with_versions(od.with_lifecycle(seen, life), life))
        if not od.overfilled(lives).isEmpty():
            lives = cut(od.settled(lives, life))
        gate = lambda rows, rule: self.say(rows, rule, F.when(F.col("untrusted"), "unverifiable").otherwise("violation"), F.when(F.col("untrusted"), "untrusted"))
        q = od.quantities(lives)
        out += [
            gate(od.dangling(lives, "execute"), "REF.EXEC_DANGLING_ORDER"), gate(od.dangling(lives, "cancel"), "REF.CANCEL_DANGLING_ORDER"),
            gate(od.duplicate_adds(lives, life), "REF.DUPLICATE_LIVE_ORDERADD"), gate(od.after_removal(lives), "REF.OPERATION_AFTER_REMOVAL"),
            gate(od.wrong_side(lives), "REF.SIDE_PRICE_CONSISTENCY"), gate(od.other_source(lives), "FIELD.SOURCE_ID_CONSISTENCY"),
            gate(q.where("overfill"), "REF.EXEC_OVERFILL"), gate(q.where("disagree"), "REF.FULLFILL_FLAG_DISAGREEMENT"),
        ]
        t = trades.select(*_PLACE, "era_no", "pos", "dirty", "instrument", "trade_id")
        lone = od.ungrouped_trades(t, executes.select(*BOOK, "pos", "trade_id"), BOOK)
        out.append(self.say(lone, "TRADE.EXEC_GROUPING"))
        marks = self._batch_marks(batches, lives)
        out.append(gate(marks, "BATCH.ATOMICITY_CONSISTENCY"))
        for rule, facts in (("FIELD.ORDERADD_PRICE_BOUND", adds), ("REF.EXEC_PRICE_BOUND", executes)):
            k = rd.price_bound(self.known(facts.select(*_PLACE, "pos", "instrument", "price"), "price_bound"), "price")
            out.append(self.say(k, rule, F.col("status"), F.when(F.col("status") == "unverifiable", "cold_start")))
        return out + self._order_snapshots(s, lives, resets)

    def _batch_marks(self, batches: DataFrame, lives: DataFrame) -> DataFrame:
        """Orders with nothing left that a boundary finds live: their last event before it left 0 without ending them."""
        left = F.when(F.col("kind") == "add", F.col("qty")).otherwise(F.col("entry_qty") - F.col("filled") - F.coalesce("qty", F.lit(0)))
        spent = lives.where("life > 0 and not removed and kind <> 'cancel' and not coalesce(full_fill, false)").where(left == 0)
        b = batches.select(*CHANNEL, "pos", F.col("pos").alias("boundary"))
        return asof(spent, b, CHANNEL, "pos", ["boundary"], strict=True, forward=True, cuts=self.channel_cuts).where("boundary is not null")

    def _order_snapshots(self, s: DataFrame, lives: DataFrame, resets: DataFrame) -> list[DataFrame | None]:
        g = self._groups("snapshot_order", F.col("order_id").cast("string"), "order_id", "side", "price", "qty", "flags", "enter_ts")
        shape, dirty, port_dirty = self._structure(g), F.coalesce("dirty", F.lit(False)), F.coalesce("port_dirty", F.lit(False))
        gated = lambda rule, bad: self.say(g.where(bad), rule, F.when(dirty, "unverifiable").otherwise("violation"), F.when(dirty, "loss"))
        over = F.col("received") > F.col("total")
        counted = F.when(over | ~(dirty | port_dirty), "violation").otherwise("unverifiable")
        out = [
            gated("SNAP.BEGIN_ORDER_END_GROUPING", shape["open"]), self.say(g.where(shape["count"]), "SNAP.TOTAL_ORDERS_COUNT_MATCH", counted, F.when(~over & (dirty | port_dirty), "loss")),
            gated("SNAP.END_FIELDS_MATCH_BEGIN", shape["end"]), gated("SNAP.ORDER_SNAPSHOT_ID_MATCH", shape["id"]),
            gated("SNAP.SNAPSHOT_ORDER_NO_DUP_ORDER_ID", shape["dup"]), gated("SNAP.EMPTY_BOOK_WELL_FORMED", shape["empty"]),
        ]
        top = self.accepted.where("port = 'mktdata'").select(*CHANNEL, F.struct("pos.emit_pos", "pos.era_no", "pos.seq", F.lit(-1).alias("msg_index")).alias("pos"), "seq", "era_no", F.col("dirty").alias("mkt_lost"))
        top = with_gaps(top, [*CHANNEL, "era_no"], "seq", ["pos"], self.cuts).select(*CHANNEL, "era_no", "pos", "mkt_lost", F.greatest("seq", "prev_max").alias("top_seq"))
        late = asof(g, top, [*CHANNEL, "era_no"], "pos", ["top_seq", "mkt_lost"], cuts=self.cuts)
        ever = top.groupBy(*CHANNEL, "era_no").agg(F.max("top_seq").alias("ever"))  # what the buffer still held counts as out of order
        ahead = late.where("anchor > coalesce(top_seq, -1)").join(ever, [*CHANNEL, "era_no"])
        held = (F.col("anchor") <= F.col("ever")) | F.coalesce("mkt_lost", F.lit(False))
        out.append(self.say(ahead, "SNAP.ANCHOR_IS_MKTDATA_SEQ", F.when(held, "unverifiable").otherwise("violation"), F.when(held, "reorder")))
        checks = sn.with_anchor_checks(g.withColumn("pruned", F.floor(F.col("life_no") / _PRUNED)), [*BOOK, "pruned"])
        for rule, status in (("SNAP.ANCHOR_MONOTONIC_PER_INSTRUMENT", "anchor_status"), ("SNAP.SNAPSHOT_ID_MONOTONIC", "id_status")):
            lost = (F.col(status) == "violation") & port_dirty
            out.append(self.say(checks, rule, F.when(lost, "unverifiable").otherwise(F.col(status)), F.when(lost, "loss").when(F.col(status) == "unverifiable", "cold_start")))
        track = s.select(*LIFE, "pos", F.greatest("per_seq", "prev_max").alias("tracker"), "broken", "repeated")
        k = asof(late, track.select(*LIFE, "pos", "tracker"), LIFE, "pos", ["tracker"])
        unsure = port_dirty | F.coalesce("mkt_lost", F.lit(False))
        out.append(self.say(k.where("tracker is not null and tracker < last_seq"), "SNAP.LAST_INSTRUMENT_SEQ_CONSISTENT_WITH_DELTAS", F.when(unsure, "unverifiable").otherwise("violation"), F.when(unsure, "reorder")))
        out.append(self.say(k.where("ended and tracker is not null"), "SNAP.ANCHOR_LE_OR_GT_LAST_APPLIED_HANDLING", "pass"))
        if self.asked("SNAP.ROUND_ROBIN_COVERS_MANIFEST"):
            out.append(self._round_robin(g))
        keys = [*CHANNEL, "era_no", "island"]
        orders = self.snapshot_rows.where("kind = 'row'").select(*keys, "port", "seq", "pos", "order_id", "side", "price", "qty", "flags", "enter_ts").join(g.select(*keys, "instrument", "life_no"), keys)
        bound = rd.price_bound(self.known(orders.select(*_PLACE, "pos", "instrument", "price"), "price_bound"), "price")
        out.append(self.say(bound, "SNAP.ORDER_PRICE_BOUND", F.col("status"), F.when(F.col("status") == "unverifiable", "cold_start")))
        if self.asked("SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT"):
            out.append(self._order_audits(g, shape, track, top, lives, orders))
        return [*out, *(self._recoveries(s, g, resets) if self.asked(*RECOVERED) else [])]

    def _round_robin(self, g: DataFrame) -> DataFrame:
        """A finding for each instrument of the sets in force at the end, and for each channel whose set never got
        complete: covered by a snapshot group of the last era, or not after two rounds of them."""
        newest = self.accepted.groupBy(*CHANNEL).agg(F.max("era_no").alias("era_no"))
        done = g.where("ended").join(newest, [*CHANNEL, "era_no"], "left_semi").groupBy(*CHANNEL, "instrument").agg(F.count("*").alias("n"))
        rounds = done.groupBy("capture_id").agg(F.max("n").alias("rounds"))
        last = F.struct("era_no", "session", "generation", "serving")
        refdata = self.sets.select(*CHANNEL, "pos", last.alias("s"))
        now = refdata.groupBy(*CHANNEL).agg(F.max_by("s", "pos").alias("s")).select(*CHANNEL, "s.*")
        now = now.join(self.ready.select(*SET, F.lit(True).alias("complete")), SET, "left").withColumn("complete", F.coalesce(F.col("complete") & F.col("serving"), F.lit(False)))
        own = now.where("complete").join(self.definitions.select(*SET, "instrument").distinct(), SET).join(done, [*CHANNEL, "instrument"], "left").join(rounds, ["capture_id"], "left")
        few = F.coalesce("rounds", F.lit(0)) < 2
        v = sn.verdict([(few, "unverifiable", "insufficient_window"), (F.col("n").isNull(), "violation", None)])
        rule = "SNAP.ROUND_ROBIN_COVERS_MANIFEST"
        own = own.withColumn("v", v)
        return _say(own, rule, F.col("v.status"), F.col("v.reason")).unionByName(_say(now.where("not complete"), rule, "unverifiable", "cold_start"))

    def _recoveries(self, s: DataFrame, g: DataFrame, resets: DataFrame) -> list[DataFrame | None]:
        """What follows an instrument reset: a snapshot group before any change, with the reset's anchor, and after it the
        number next to the group's. A reset that another one, or a new era, follows first has no finding."""
        r = resets.select(*_PLACE, "era_no", "pos", "instrument", F.col("anchor").cast("bigint").alias("anchor"))
        ended = g.where("ended").select(*BOOK, F.col("end_pos").alias("pos"), F.col("end_pos").alias("group_pos"), F.col("anchor").alias("group_anchor"), F.col("last_seq").alias("group_k"), "dirty")
        rec = asof(r, ended.withColumnRenamed("dirty", "torn"), BOOK, "pos", ["group_pos", "group_anchor", "group_k", "torn"], strict=True, forward=True)
        changes = s.select(*BOOK, "pos", F.col("pos").alias("delta_pos"), F.col("seq").alias("delta_seq"), "per_seq")
        rec = asof(rec, changes, BOOK, "pos", ["delta_pos", "delta_seq"], strict=True, forward=True)
        rec = asof(rec, r.select(*BOOK, "pos", F.col("pos").alias("next_reset")), BOOK, "pos", ["next_reset"], strict=True, forward=True)
        newest = self.accepted.groupBy(*CHANNEL).agg(F.max("era_no").alias("newest"))
        first = F.least("group_pos", "delta_pos")
        rec = rec.join(newest, CHANNEL).where((first.isNotNull() & (F.col("next_reset").isNull() | (first < F.col("next_reset")))) | (first.isNull() & F.col("next_reset").isNull() & (F.col("era_no") == F.col("newest"))))
        rec = cut(rec.withColumn("late", F.col("group_pos").isNull() | F.coalesce(F.col("delta_pos") < F.col("group_pos"), F.lit(False))))
        bound = F.lit("snapshot" in self.settings.ports)
        late = rec.where("late").withColumn("pos", F.col("delta_pos")).withColumn("seq", F.coalesce("delta_seq", F.lit(0)))
        met = rec.where("not late").withColumn("pos", F.col("group_pos")).withColumn("port", F.lit("snapshot"))
        wrong, torn = F.col("group_anchor") != F.col("anchor"), F.coalesce("torn", F.lit(False))
        nxt = asof(met.drop("delta_pos", "delta_seq"), changes, BOOK, "pos", ["delta_pos", "delta_seq", "per_seq"], strict=True, forward=True)
        nxt = nxt.where("per_seq is not null and (next_reset is null or delta_pos < next_reset)").withColumn("port", F.lit("mktdata"))
        # The last group before the change says what number comes next.
        nxt = asof(nxt.drop("group_k").withColumn("pos", F.col("delta_pos")).withColumn("seq", F.col("delta_seq")), ended, BOOK, "pos", ["group_k"])
        return [
            self.say(late, "RESET.SNAPSHOT_FOLLOWS", F.when(~bound, "na").otherwise("violation")),
            self.say(met, "RESET.SNAPSHOT_FOLLOWS", F.when(~bound, "na").otherwise("pass")),
            self.say(met, "RESET.RECOVERY_SNAPSHOT_ANCHOR_MATCHES_RESET", F.when(~wrong, "pass").when(torn, "unverifiable").otherwise("violation"), F.when(wrong & torn, "loss")),
            self.say(nxt, "RESET.NO_DANGLING_DELTAS_AT_OR_BELOW_ANCHOR", F.when(F.col("per_seq") == F.col("group_k") + 1, "pass").otherwise("violation")),
        ]

    def _order_audits(self, g: DataFrame, shape: dict[str, Column], track: DataFrame, top: DataFrame, lives: DataFrame, orders: DataFrame) -> DataFrame:
        """Each completed group against the live orders of its life, by what was known when it ended: a later gap changes
        no verdict. A group that can be compared has just the number the deltas had reached."""
        ended = g.where(F.col("ended") & (F.col("orphans") == 0)).withColumn("k", F.col("last_seq")).withColumn("begin", F.col("pos")).withColumn("pos", F.col("end_pos"))
        few, frames = is_few(g), top.select(*CHANNEL, "era_no", "pos", "mkt_lost")
        if few:
            a = asof_of_few(asof_of_few(ended, track, LIFE, "pos", ["tracker", "broken", "repeated"]), frames, [*CHANNEL, "era_no"], "pos", ["mkt_lost"])
        else:
            a = asof(asof(ended, track, LIFE, "pos", ["tracker", "broken", "repeated"]), frames, [*CHANNEL, "era_no"], "pos", ["mkt_lost"], cuts=self.cuts)
        a = self.known(a)
        no = lambda c: F.coalesce(F.col(c), F.lit(False))
        bad = F.lit(False)
        for name in ("count", "end", "id", "dup", "empty"):
            bad = bad | shape[name]
        why = (
            F.when(bad, "superseded").when(F.col("known").isNull() | F.col("channel_ready").isNull(), "cold_start").when(F.col("tracker").isNull() | no("broken"), "untrusted")
            .when(no("repeated"), "reorder").when(no("mkt_lost"), "loss").when(F.col("tracker") != F.col("k"), "pending").when(no("dirty"), "loss")
        )
        a = cut(a.withColumn("why", why))
        compared = a.where("why is null")
        keys, values = [*LIFE, "k", "island"], ["remaining", "price", "side", "flags", "enter_ts"]
        hidden = orders.where(F.col("flags").bitwiseAND(F.lit(4).cast("bigint")) != 0).select(*CHANNEL, "era_no", "island", "order_id")
        none = hidden.isEmpty()
        island = [*CHANNEL, "era_no", "island", "order_id"]
        own = F.broadcast(compared.select(*keys)) if few else compared.select(*keys)
        book = lv.at_points(od.versions(lives, LIFE), compared.select(*LIFE, "k"), LIFE, "per_seq", "until", few).join(own, [*LIFE, "k"])
        snap = orders.withColumnRenamed("qty", "remaining").join(own, [*LIFE, "island"])
        kept = lambda rows: (rows if none else rows.join(hidden, island, "left_anti")).select(*keys, "order_id", *(F.col(v).cast("bigint").alias(v) for v in values))
        diff = sn.signatures(sn.book_diff(kept(snap), kept(book.withColumn("order_id", F.col("order_id").cast("bigint"))), keys, ["order_id"], values), keys, ["order_id"])
        compared = compared.join(diff.select(*keys, "signature", "shown"), keys, "left").withColumn("signature", F.coalesce("signature", F.lit("")))
        compared = sn.oracle_status(compared, LIFE, "pos", self.settings.confirm_cycles)
        every = compared.unionByName(a.where("why is not null").withColumn("status", F.lit("unverifiable")), allowMissingColumns=True)
        return self.say(every.withColumn("pos", F.col("begin")), "SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", F.col("status"), F.col("why"), F.col("shown"))

    def findings(self, made: list[str] | None = None) -> DataFrame:
        with _tasks(self.frames.sparkSession, self.channel_cuts and self.channel_cuts.tasks):
            return self._findings(made)

    def _findings(self, made: list[str] | None) -> DataFrame:
        """rule_id, severity, status, reason, capture_id, port, channel_id, instrument, seq, detail. The tables in ``made``
        are deleted when the findings no longer need them."""
        parts = [*self.envelope(), *self.reference()]
        parts += {"tob": self.top_of_book, "midpoint": self.midpoint, "mbp": self.market_by_price, "mbo": self.market_by_order}[self.feed]()
        parts = [p for p in parts if p is not None]
        gate = cut(self.loss_gate())
        used = list(made or ())[:-1]
        # A plan for each few parts: fewer jobs than parts, and none too long to be planned.
        out = reduce(DataFrame.unionByName, (cut(reduce(DataFrame.unionByName, parts[k : k + 8])) for k in range(0, len(parts), 8)))
        spark = out.sparkSession
        delete(spark, used)
        missing = [(r, "na") for r in starved(self.feed, set(self.settings.ports))]
        missing = [m for m in missing if self.asked(m[0])]
        if missing:
            none = spark.createDataFrame(missing, "rule_id string, status string").withColumns({"capture_id": F.lit(""), "channel_id": F.lit(0)})
            out = out.unionByName(_say(none, F.col("rule_id"), F.col("status")))
        return graded(self.gated(out, gate), self.settings.configured(), F.col("future")).withColumn("feed", F.lit(self.feed)).drop("future")


def check(datagrams: DataFrame, feed: str, settings: Settings = Settings(), rules: Collection[str] | None = None) -> DataFrame:
    """Findings of datagrams (capture_id, arrival, port, raw) of one feed. With ``rules``, those of these rules, from the
    same datagrams by the same steps; what only other rules need is not worked out."""
    assert rules is None or rules and set(rules) <= set(RULES), rules
    unknown = [r for r in settings.configured() if r not in RULES]
    assert not unknown, unknown
    with collected() as made:
        return Run(datagrams, feed, settings, rules).findings(made)
