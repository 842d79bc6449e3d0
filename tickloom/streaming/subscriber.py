"""A subscriber of a price-level feed as two chained stateful streams.

``sequence`` (a key is a channel) lets frames go in order, numbers eras across ports, follows reference data and collects
snapshot groups; ``follow`` (a key is an instrument) keeps its book: the group adopted last as the base, a journal of the
changes beyond it, and what was missed since. Fields are read by the planner, in one pass over the messages; the state
machines see numbers only. State is bounded by the reorder window, the group that is open, a channel's instruments, and
per instrument by one group and ``journal`` changes. Each stream's output is a table that the next one reads, so either may
be restarted from its checkpoint.

Verdicts are those of the batch engine, with two differences: rows after a group's end don't change its verdict, and frames
in the reorder buffer wait for later ones.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.layout import FRAME_HEADER, MAGIC, MESSAGE_HEADER, of_feed
from ..functions.wire import reading
from ..operators.frames import decode_frames
from ..operators.refdata import Manifests

FEED = "mbp"
KINDS = ("manifest", "definition", "level_update", "book_clear", "instrument_reset", "snapshot_begin", "snapshot_level", "snapshot_end")
FIELDS = ("instrument", "per_seq", "side", "price", "qty", "clear_side", "scope", "from_price", "snapshot_id", "anchor", "total", "last_seq", "valid", "manifest_seq", "count")
CHANNEL = ["capture_id", "channel_id"]
SEQUENCED = "capture_id string, channel_id bigint, instrument bigint, at bigint, era_no bigint, seq bigint, kind string, fact string"
VERDICTS = "capture_id string, channel_id bigint, instrument bigint, at bigint, seq bigint, rule_id string, status string, reason string"
GROUPS, BOOKS = "MBP.SNAP.GROUP_STRUCTURE", "MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT"
DENSITY, RESTART = "MBP.DELTA.PERINSTR_DENSITY", "MBP.DELTA.PERINSTR_NO_SNAPSHOT_RESET"


def facts(datagrams: DataFrame) -> DataFrame:
    """A row for each message of datagrams (capture_id, arrival, port, raw), and one for a frame without any: the frame's
    place, ``kind`` (null where a subscriber has no use for it) and FIELDS."""
    f = decode_frames(datagrams, FEED).where((F.octet_length("raw") >= FRAME_HEADER) & (F.col("magic") == MAGIC[FEED]))
    m = f.select(*CHANNEL, "arrival", "port", "seq", "reset_count", F.xxhash64("raw").alias("payload"), "raw", F.posexplode_outer("starts").alias("msg_index", "at"))
    byte = "cast(conv(hex(substring(raw, at + {}, 1)), 16, 10) as int)"
    m = m.withColumns({"type": F.expr(byte.format(1)), "body": F.expr(f"substring(raw, at + {MESSAGE_HEADER + 1}, {byte.format(2)} - {MESSAGE_HEADER})")})
    own = {x.name: x for x in of_feed(FEED) if x.name in KINDS}
    kind = " ".join(f"when port = '{x.port}' and type = {x.type} then '{n}'" for n, x in own.items())
    m = m.withColumn("kind", F.expr(f"case {kind} end"))
    columns = []
    for name in FIELDS:
        cases = " ".join(f"when '{n}' then cast({reading('body', f)} as bigint)" for n, x in own.items() for f in x.fields if f.name == name)
        columns.append(f"case kind {cases} end as {name}")
    return m.selectExpr(*CHANNEL, "arrival", "port", "seq", "reset_count", "payload", "coalesce(msg_index, 0) as msg_index", "kind", *columns)


class Port:
    """Frames of one port: accepted eras, reorder buffer, frames seen, and what was lost."""

    def __init__(self, window: int, s: dict | None = None):
        s = s or {}
        self.window, self.count, self.era, self.last = window, s.get("count"), s.get("era", 0), s.get("last")
        self.heap = [tuple(x) for x in s.get("heap", [])]
        self.ring = [tuple(x) for x in s.get("ring", [])]

    def state(self) -> dict:
        return {k: getattr(self, k) for k in ("count", "era", "last", "heap", "ring")}

    def push(self, frame: tuple, reset: int, newest: tuple[int, int] | None) -> Iterator[tuple[int, int, int, list]]:
        """(era, seq, frames missing before it, messages) of the frames that leave; ``frame`` is (seq, arrival, payload,
        messages)."""
        if self.count is None:
            self.era = 0 if newest is None else newest[0] + (reset - newest[1] + 128) % 256 - 128
            self.count = reset
        ahead = (reset - self.count) % 256
        if ahead >= 128:
            return
        if ahead:
            while self.heap:
                yield from self._leave()
            self.era, self.count, self.last, self.ring = self.era + ahead, reset, None, []
        heapq.heappush(self.heap, frame)
        while len(self.heap) > self.window:
            yield from self._leave()

    def _leave(self) -> Iterator[tuple[int, int, int, list]]:
        seq, _, _, messages = heapq.heappop(self.heap)
        if any(seq == x[0] for x in self.ring):
            return
        self.ring = [*self.ring, (seq,)][-max(16, 2 * self.window) :]
        missing = max(0, seq - self.last - 1) if self.last is not None else 0
        self.last = seq if self.last is None else max(self.last, seq)
        yield self.era, seq, missing, messages


class Refdata:
    """waiting for a manifest, collecting the set's definitions, or ready."""

    def __init__(self, s: dict | None = None):
        s = s or {"state": "waiting", "defs": [], "manifests": [None, None, None, 0]}
        self.state, self.defs, self.manifests = s["state"], set(s["defs"]), Manifests()
        m = self.manifests
        m.seq, m.count, m.expected, m.generation = s["manifests"]

    def dump(self) -> dict:
        m = self.manifests
        return {"state": self.state, "defs": sorted(self.defs), "manifests": [m.seq, m.count, m.expected, m.generation]}

    def take(self, x: dict) -> str | None:
        """The state if the message changes it."""
        before = (self.state, self.manifests.generation)
        if x["kind"] == "manifest":
            if x["valid"] == 0:
                self.__init__()
            elif self.manifests(x["valid"], x["manifest_seq"], x["count"])[2]:
                self.defs, self.state = set(), "collecting"
        elif self.state != "waiting" and x["manifest_seq"] == self.manifests.seq:
            self.defs.add(x["instrument"])
            if self.state == "collecting" and len(self.defs) == self.manifests.expected:
                self.state = "ready"
        return self.state if (self.state, self.manifests.generation) != before else None


class Channel:
    """What a channel's frames are turned into: changes, complete snapshot groups, and states of reference data."""

    def __init__(self, window: int, s: dict | None = None):
        s = s or {}
        self.window, self.at, self.newest = window, s.get("at", 0), s.get("newest")
        self.ports = {p: Port(window, x) for p, x in s.get("ports", {}).items()}
        self.open, self.refdata, self.ref_era = s.get("open"), Refdata(s.get("refdata")), s.get("ref_era")

    def dump(self) -> dict:
        return {"at": self.at, "newest": self.newest, "ports": {p: x.state() for p, x in self.ports.items()}, "open": self.open, "refdata": self.refdata.dump(), "ref_era": self.ref_era}

    def push(self, port: str, frame: tuple, reset: int) -> Iterator[tuple]:
        """(instrument, at, era, seq, kind, fact) rows."""
        own = self.ports.setdefault(port, Port(self.window))
        for era, seq, missing, messages in own.push(frame, reset, tuple(self.newest) if self.newest else None):
            if port == "refdata" and era != self.ref_era:
                self.refdata, self.ref_era = Refdata(), era
            for n, x in enumerate(messages):
                for instrument, kind, fact in self._take(x, era, seq, missing if n == 0 else 0):
                    self.at += 1
                    yield instrument, self.at, era, seq if kind != "group" else fact["seq"], kind, json.dumps(fact)
        if self.newest is None or own.era > self.newest[0]:
            self.newest = [own.era, own.count]

    def _take(self, x: dict, era: int, seq: int, missing: int) -> Iterator[tuple]:
        kind, group = x["kind"], self.open
        if group and x["port"] == "snapshot":
            if group["era"] != era:
                yield self._closed(False)
                group = None
            elif missing and seq > group["seq"]:
                group["torn"] = True
        if kind in ("manifest", "definition"):
            if (state := self.refdata.take(x)) is not None:
                yield 0, "refdata", {"state": state}
        elif kind in ("level_update", "book_clear", "instrument_reset"):
            yield x["instrument"], kind, {c: x[c] for c in ("per_seq", "side", "price", "qty", "clear_side", "scope", "from_price")}
        elif kind == "snapshot_begin":
            if group:
                yield self._closed(False)
            self.open = {k: x[k] for k in ("instrument", "snapshot_id", "anchor", "total", "last_seq")} | {"era": era, "seq": seq, "torn": False, "bad": False, "levels": []}
        elif kind == "snapshot_level" and group:
            group["bad"] |= x["snapshot_id"] != group["snapshot_id"]
            group["levels"].append([x["side"], x["price"], x["qty"]])
        elif kind == "snapshot_end" and group:
            group["bad"] |= any(x[c] != group[c] for c in ("instrument", "snapshot_id", "anchor"))
            yield self._closed(True)

    def _closed(self, ended: bool) -> tuple:
        g, self.open = self.open, None
        bad = g["bad"] or g["total"] != len(g["levels"]) or len({tuple(x[:2]) for x in g["levels"]}) < len(g["levels"])
        status = "unverifiable/loss" if g["torn"] and (bad or not ended) else "unverifiable/truncated" if not ended else "violation" if bad else "pass"
        return g["instrument"], "group", {"seq": g["seq"], "k": g["last_seq"], "status": status, "levels": g["levels"] if status == "pass" else []}


class Book:
    """One instrument in one era: the base, the journal beyond it, the number reached, and what was missed since the last
    group."""

    def __init__(self, journal: int, empty_start: bool, s: dict | None = None):
        self.limit, self.empty_start = journal, empty_start
        self.s = s or {"number": None, "base_k": None, "base": [], "journal": [], "gapped": False, "taken": 0, "kept": 0, "after_group": False}

    def change(self, kind: str, x: dict) -> Iterator[tuple[str, str, str]]:
        s, n = self.s, x["per_seq"]
        number, after, s["after_group"] = s["number"], s["after_group"], False
        if number is not None and n > number + 1:
            s["gapped"] = True
            yield DENSITY, "violation", ""
        if after and n == 1 and number is not None and number > 1:
            s["gapped"] = True
            yield RESTART, "violation", ""
        malformed = kind == "book_clear" and x["scope"] == 1 and x["clear_side"] == 2
        s["gapped"] |= malformed
        if number is None or n > number:
            s["number"], s["taken"] = n, s["taken"] + 1
            if not malformed and s["kept"] + s["taken"] <= self.limit:  # beyond it, the next group can't be compared
                s["journal"].append([n, x["side"], x["price"], x["qty"]] if kind == "level_update" else [n, x["clear_side"], x["scope"], x["from_price"], None])

    def group(self, x: dict) -> tuple[str, str, str]:
        """The verdict of a group, which is adopted whatever it is."""
        s, k = self.s, x["k"]
        overflow = s["kept"] + s["taken"] > self.limit
        if s["gapped"]:
            found = "unverifiable/loss"
        elif overflow:
            found = "unverifiable/overflow"
        elif s["base_k"] is None and (k > 0 or x["levels"] or not self.empty_start):
            found = "unverifiable/cold_start"
        elif s["base_k"] is not None and k < s["base_k"]:
            found = "unverifiable/reorder"
        elif k > (s["number"] or 0):
            found = "unverifiable/pending"
        elif s["base_k"] is None:
            found = "pass"
        else:
            found = "pass" if self.replayed(k) == {(a, b): q for a, b, q in x["levels"]} else "violation"
        before = s["number"]
        if k > 0:
            s["number"] = max(before or 0, k)
        if s["base_k"] is None or k >= s["base_k"]:
            s["base_k"], s["base"] = k, x["levels"]
            s["journal"] = [c for c in s["journal"] if c[0] > k]
        s.update(gapped=False, taken=0, kept=max((before or 0) - k, 0), after_group=True)
        status, _, reason = found.partition("/")
        return BOOKS, status, reason

    def replayed(self, k: int) -> dict[tuple[int, int], int]:
        """The base and the changes up to number k."""
        book = {(a, b): q for a, b, q in self.s["base"]}
        for n, *c in self.s["journal"]:
            if n > k:
                break
            if len(c) == 3:
                side, price, qty = c
                book.pop((side, price), None)
                if qty > 0:
                    book[side, price] = qty
            else:
                sides, scope, bound, _ = c
                for side, price in list(book):
                    if sides in (2, side) and (scope == 0 or (price <= bound if side == 0 else price >= bound)):
                        del book[side, price]
        return book


def _streamed(rows: DataFrame, keys: list[str], schema: str, order: list[str], step: Callable[[dict, pd.DataFrame], tuple[list[tuple], dict]]) -> DataFrame:
    """``step`` over the new rows of each key, in order, with the key's state as a dictionary."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, after = step(json.loads(state.get[0]) if state.exists else {}, pd.concat(list(batches)).sort_values(order, kind="stable"))
        state.update((json.dumps(after),))
        yield pd.DataFrame([(*key, *x) for x in found], columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def sequence(datagrams: DataFrame, window: int = 8) -> DataFrame:
    """Streaming datagrams as SEQUENCED rows, in order of ``at`` within a channel."""

    def step(state: dict, pdf: pd.DataFrame) -> tuple[list[tuple], dict]:
        channel, out = Channel(window, state), []
        for (arrival, port, seq, reset, payload), part in pdf.groupby(["arrival", "port", "seq", "reset_count", "payload"], sort=False):
            messages = [{"port": port, "kind": r.kind} | {c: None if pd.isna(v := getattr(r, c)) else int(v) for c in FIELDS} for r in part.itertuples(index=False)]
            out += channel.push(port, (int(seq), int(arrival), int(payload), messages), int(reset))
        return out, channel.dump()

    return _streamed(facts(datagrams), CHANNEL, SEQUENCED, ["arrival", "msg_index"], step)


def follow(sequenced: DataFrame, journal: int = 4096, empty_start: bool = False) -> DataFrame:
    """Streaming SEQUENCED rows as VERDICTS. The two newest eras of an instrument are kept."""

    def step(state: dict, pdf: pd.DataFrame) -> tuple[list[tuple], dict]:
        books, out = {int(e): Book(journal, empty_start, s) for e, s in state.items()}, []
        for r in pdf.itertuples(index=False):
            era, x = int(r.era_no), json.loads(r.fact)
            if r.kind == "instrument_reset" or era not in books:
                books[era] = Book(journal, empty_start)
            found = []
            if r.kind == "group":
                status, _, reason = x["status"].partition("/")
                found.append((GROUPS, status, reason))
                if status == "pass":
                    found.append(books[era].group(x))
            elif r.kind in ("level_update", "book_clear"):
                found += books[era].change(r.kind, x)
            out += [(int(r.at), int(r.seq), *f) for f in found]
            books = {e: books[e] for e in sorted(books)[-2:]}
        return out, {str(e): b.s for e, b in books.items()}

    return _streamed(sequenced.where("kind <> 'refdata'"), [*CHANNEL, "instrument"], VERDICTS, ["at"], step)
