"""Whole tapes through the engine: conformant ones are clean, and each fault gives its finding."""

import struct


from tests.test_wire import raw_frame, raw_message
from tickloom.engine import Settings, check
from tickloom.functions.layout import message


def build(feed, name, **values):
    """The bytes of a message by its layout."""
    m = message(feed, name)
    raw = bytearray(m.length)
    for f in m.fields:
        if f.name in values and f.kind[0] in "ui":
            raw[f.offset : f.offset + f.size] = int(values[f.name]).to_bytes(f.size, "little", signed=f.kind[0] == "i")
    return raw_message(m.type, m.length, bytes(raw[4:]), 1 if feed == "mbp" and m.port == "snapshot" else 0)


class Tape:
    def __init__(self, feed, channel=3):
        self.feed, self.channel, self.rows, self.next = feed, channel, [], {}

    def send(self, port, *messages, skip=0, reset=0, ts=None):
        seq = self.next.get(port, 0) + skip
        self.next[port] = seq + 1
        raw = bytearray(raw_frame(self.feed, *messages, seq=seq, channel=self.channel, reset=reset))
        raw[12:20] = struct.pack("<Q", 1000 + len(self.rows) if ts is None else ts)
        self.rows.append(("tape", len(self.rows), port, raw))
        return seq

    def msg(self, name, **values):
        return build(self.feed, name, **({"channel": self.channel} | values))

    def refdata(self, instrument=7, bound=1, **more):
        for _ in range(2):
            self.send("refdata", self.msg("manifest", valid=1, manifest_seq=1, count=1))
            self.send("refdata", self.msg("definition", instrument=instrument, manifest_seq=1, price_bound=bound, **more))

    def run(self, spark, settings=Settings(window=1)):
        return run_all(spark, {"tape": self}, settings)["tape"]


def run_all(spark, tapes, settings=Settings(window=1, empty_start=True)):
    """Findings of several tapes of one feed, as captures of one run."""
    feed = next(iter(tapes.values())).feed
    rows = [(str(name), *row[1:]) for name, t in tapes.items() for row in t.rows]
    df = spark.createDataFrame(rows, "capture_id string, arrival bigint, port string, raw binary")
    out = {name: [] for name in tapes}
    by = {str(name): name for name in tapes}
    for r in check(df, feed, settings).select("capture_id", "rule_id", "status").collect():
        if r["capture_id"] in by:
            out[by[r["capture_id"]]].append((r["rule_id"], r["status"]))
    return {name: sorted(found) for name, found in out.items()}


def violations(found):
    return sorted({r for r, s in found if s == "violation"})


def order_tape(fault=None):
    t = Tape("mbo")
    t.refdata()
    t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=0, total=0, snapshot_id=1, last_seq=0), t.msg("snapshot_end", instrument=7, anchor=0, snapshot_id=1))
    t.send("mktdata", t.msg("order_add", instrument=7, source=1, side=0, per_seq=1, order_id=1001, price=100, qty=10))
    t.send("mktdata", t.msg("order_add", instrument=7, source=1, side=1, per_seq=2, order_id=1002, price=200, qty=5))
    if fault == "gap":
        t.send("mktdata", t.msg("heartbeat"), skip=2)
    seq = 4 if fault == "density" else 3
    t.send("mktdata", t.msg("order_cancel", instrument=7, source=1, per_seq=seq, order_id=9 if fault == "dangling" else 1002))
    if fault == "overfill":
        t.send("mktdata", t.msg("order_execute", instrument=7, source=1, aggressor=2, per_seq=4, order_id=1001, trade_id=1, price=100, qty=11))
    if fault == "removed":
        t.send("mktdata", t.msg("order_cancel", instrument=7, source=1, per_seq=4, order_id=1002))
    if fault == "bound":
        t.send("mktdata", t.msg("order_add", instrument=7, source=1, side=0, per_seq=4, order_id=1003, price=-5, qty=1))
    last = t.send("mktdata", t.msg("heartbeat"))
    k = 4 if fault in ("overfill", "removed", "bound", "density") else 3
    for cycle in range(2):
        rows = [t.msg("snapshot_order", snapshot_id=2 + cycle, order_id=1001, side=0, price=100, qty=9 if fault == "book" else 10)]
        t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=last, total=2 if fault == "count" else 1, snapshot_id=2 + cycle, last_seq=k), *rows, t.msg("snapshot_end", instrument=7, anchor=last, snapshot_id=2 + cycle))
    return t


ORDER_FAULTS = {
    None: [],
    "gap": [],
    "density": ["DELTA.PERINSTR_DENSITY"],
    "dangling": ["REF.CANCEL_DANGLING_ORDER", "SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT"],
    "removed": ["REF.OPERATION_AFTER_REMOVAL"],
    "overfill": ["REF.EXEC_OVERFILL"],
    "bound": ["FIELD.ORDERADD_PRICE_BOUND", "SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT"],
    "count": ["SNAP.TOTAL_ORDERS_COUNT_MATCH"],
    "book": ["SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT"],
}


def test_order_feed(spark):
    found = run_all(spark, {f: order_tape(f) for f in ORDER_FAULTS})
    got = {f: [r for r in violations(found[f]) if f != "overfill" or r.startswith("REF.")] for f in ORDER_FAULTS}
    assert got == ORDER_FAULTS, found
    assert ("SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "pass") in found[None] and ("FIELD.ORDERADD_PRICE_BOUND", "pass") in found[None]
    assert ("SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "suspected") in found["book"]
    assert ("SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "unverifiable") in found["gap"]


def test_rules_asked_for_are_those_of_the_whole_check(spark):
    """Asking for some rules leaves out other findings, and changes none of theirs."""
    rows = [(f, *row[1:]) for f in ("gap", "bound", "book", "count") for row in order_tape(f).rows]
    df = spark.createDataFrame(rows, "capture_id string, arrival bigint, port string, raw binary").cache()
    settings = Settings(window=1, empty_start=True)
    columns = ["capture_id", "port", "instrument", "seq", "rule_id", "severity", "status", "reason", "detail"]
    listed = lambda found: sorted(map(str, found.select(columns).collect()))
    whole = check(df, "mbo", settings).cache()
    rules = ["FIELD.ORDERADD_PRICE_BOUND", "SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "SNAP.TOTAL_ORDERS_COUNT_MATCH"]
    want = listed(whole.where(whole.rule_id.isin(*rules)))
    assert want and listed(check(df, "mbo", settings, rules)) == want


def level_tape(fault=None):
    t = Tape("mbp")
    t.refdata()
    group = lambda i, k, rows: t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=k, total=len(rows), snapshot_id=i, last_seq=k), *(t.msg("snapshot_level", snapshot_id=i, side=s, price=p, qty=q) for s, p, q in rows), t.msg("snapshot_end", instrument=7, anchor=k, snapshot_id=i))
    group(1, 0, [])
    for n, (side, price, qty) in enumerate([(0, 100, 5), (1, 105, 6), (0, 99, 4)], 1):
        t.send("mktdata", t.msg("level_update", instrument=7, source=1, side=side, action=0, per_seq=n, price=price, qty=qty))
    t.send("mktdata", t.msg("book_clear", instrument=7, source=1, clear_side=0, scope=1, per_seq=4, from_price=99))
    t.send("mktdata", t.msg("level_update", instrument=7, source=1, side=0, action=0 if fault == "action" else 2, per_seq=6 if fault == "density" else 5, price=98, qty=0))
    t.send("mktdata", t.msg("heartbeat"))
    group(2, 4, [(0, 100, 5 if fault != "book" else 7), (1, 105, 6)])
    return t


LEVEL_FAULTS = {None: [], "density": ["MBP.DELTA.PERINSTR_DENSITY"], "action": ["MBP.DELTA.ABSOLUTE_APPLY"], "book": ["MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT"]}


def test_level_feed(spark):
    found = run_all(spark, {f: level_tape(f) for f in LEVEL_FAULTS})
    assert {f: violations(x) for f, x in found.items()} == LEVEL_FAULTS, found
    assert all(("MBP.SNAP.GROUP_STRUCTURE", "pass") in x for x in found.values())
    assert found[None].count(("MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "pass")) == 2


def test_top_of_book_and_midpoint(spark):
    t = Tape("tob")
    t.refdata()
    quote = {"source": 1, "update_flags": 3, "bid_price": 100, "bid_qty": 1, "ask_price": 200, "ask_qty": 1, "bid_count": 1, "ask_count": 1}
    t.send("mktdata", t.msg("quote", instrument=7, **quote))
    assert t.run(spark) == [("TOB.QUOTE.REFDATA_KNOWN", "pass")]
    t.send("refdata", t.msg("manifest", valid=1, manifest_seq=1, count=1))
    t.send("refdata", t.msg("manifest", valid=1, manifest_seq=1, count=1))
    t.send("mktdata", t.msg("quote", instrument=7, **quote))
    t.send("mktdata", t.msg("quote", instrument=8, **quote))
    t.send("mktdata", t.msg("heartbeat"))
    assert t.run(spark) == [("TOB.QUOTE.REFDATA_KNOWN", "pass")] * 2 + [("TOB.QUOTE.REFDATA_KNOWN", "violation")]
    m = Tape("midpoint")
    m.refdata(default_method=0)
    m.send("refdata", m.msg("manifest", valid=1, manifest_seq=1, count=1))
    m.send("mktdata", m.msg("midpoint", instrument=7, source=1, method=0, mid_price=-5))
    m.send("mktdata", m.msg("heartbeat"))
    assert violations(m.run(spark)) == ["MID.METHOD0_REQUIRES_DEFAULT", "MID.PRICE_BOUND"]


def test_starved_rules_do_not_apply(spark):
    t = Tape("mbp")
    t.refdata()
    df = spark.createDataFrame(t.rows, "capture_id string, arrival bigint, port string, raw binary")
    found = [tuple(r) for r in check(df, "mbp", Settings(window=1, ports=("mktdata", "refdata"))).select("rule_id", "status").collect()]
    assert ("MBP.SNAP.GROUP_STRUCTURE", "na") in found and not violations(found)


def level_group(t, i, k, rows):
    t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=k, total=len(rows), snapshot_id=i, last_seq=k), *(t.msg("snapshot_level", snapshot_id=i, side=s, price=p, qty=q) for s, p, q in rows), t.msg("snapshot_end", instrument=7, anchor=k, snapshot_id=i))


def level(t, n, price, qty, side=0, **more):
    t.send("mktdata", t.msg("level_update", instrument=7, source=1, side=side, action=2 if qty == 0 else 0, per_seq=n, price=price, qty=qty), **more)


def order_group(t, i, k, rows, **more):
    t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=0, total=len(rows), snapshot_id=i, last_seq=k), *(t.msg("snapshot_order", snapshot_id=i, order_id=o, side=0, price=p, qty=q) for o, p, q in rows), t.msg("snapshot_end", instrument=7, anchor=0, snapshot_id=i), **more)


def add(t, n, order_id, price=100, qty=10, **more):
    t.send("mktdata", t.msg("order_add", instrument=7, source=1, side=0, per_seq=n, order_id=order_id, price=price, qty=qty), **more)


BOOKS = {"mbp": "MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "mbo": "SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT"}


def audits(spark, tapes, settings=Settings(window=0, empty_start=True)):
    """(status, reason) of the book comparisons of tapes, in order of the groups."""
    feed = next(iter(tapes.values())).feed
    rows = [(str(name), *row[1:]) for name, t in tapes.items() for row in t.rows]
    found = check(spark.createDataFrame(rows, "capture_id string, arrival bigint, port string, raw binary"), feed, settings)
    got = {name: [] for name in tapes}
    others = {name: set() for name in tapes}
    for r in sorted(found.select("capture_id", "rule_id", "seq", "status", "reason").collect(), key=lambda r: (r["capture_id"], r["seq"] or 0)):
        if r["capture_id"] in got:
            if r["rule_id"] == BOOKS[feed]:
                got[r["capture_id"]].append(r["status"] + (f"/{r['reason']}" if r["reason"] else ""))
            elif r["status"] == "violation":
                others[r["capture_id"]].add(r["rule_id"])
    return got, others


def mbp_tapes():
    tapes = {}

    def tape(name):
        t = tapes[name] = Tape("mbp")
        t.refdata()
        level_group(t, 1, 0, [])
        return t

    t = tape("reset")  # the same numbers in two lives of the book
    level(t, 1, 90, 5), level(t, 2, 91, 6)
    level_group(t, 2, 2, [(0, 90, 5), (0, 91, 6)])
    t.send("mktdata", t.msg("instrument_reset", instrument=7, anchor=t.next["mktdata"]))
    level_group(t, 3, 0, [])
    level(t, 1, 100, 7)
    level_group(t, 4, 1, [(0, 100, 7)])

    t = tape("gap")  # what passed before a gap stays, the group after it is open and adopted, the next one passes
    level(t, 1, 90, 5)
    level_group(t, 2, 1, [(0, 90, 5)])
    level(t, 3, 92, 1)
    level_group(t, 3, 3, [(0, 90, 5), (0, 91, 2), (0, 92, 1)])
    level(t, 4, 93, 1)
    level_group(t, 4, 4, [(0, 90, 5), (0, 91, 2), (0, 92, 1), (0, 93, 1)])

    t = tape("mismatch")  # a group that differs is the base of the next one all the same
    level(t, 1, 90, 5)
    level_group(t, 2, 1, [(0, 90, 6)])
    level(t, 2, 91, 1)
    level_group(t, 3, 2, [(0, 90, 6), (0, 91, 1)])

    t = tape("clear")  # clears take what the base and the changes before them hold, and nothing after
    for n, (side, price) in enumerate([(0, 90), (0, 80), (1, 100), (1, 110)], 1):
        level(t, n, price, 3, side)
    level_group(t, 2, 4, [(0, 90, 3), (0, 80, 3), (1, 100, 3), (1, 110, 3)])
    level(t, 5, 85, 2), level(t, 6, 70, 2)
    t.send("mktdata", t.msg("book_clear", instrument=7, source=1, clear_side=0, scope=1, per_seq=7, from_price=80))
    level(t, 8, 75, 4)
    t.send("mktdata", t.msg("book_clear", instrument=7, source=1, clear_side=1, scope=0, per_seq=9, from_price=0))
    level(t, 10, 120, 1, 1)
    level_group(t, 3, 10, [(0, 90, 3), (0, 85, 2), (0, 75, 4), (1, 120, 1)])

    t = tape("cold")  # an adopted number beyond the deltas seen; the number before it is late and dropped
    level(t, 5, 90, 5)
    level_group(t, 2, 7, [(0, 91, 1)])
    level(t, 7, 99, 9)
    level(t, 8, 92, 1)
    level_group(t, 3, 8, [(0, 91, 1), (0, 92, 1)])
    level_group(t, 4, 9, [(0, 91, 1), (0, 92, 1)])
    level_group(t, 5, 8, [(0, 91, 1), (0, 92, 1)])

    t = tape("torn")  # a frame lost inside a group touches that group only
    level(t, 1, 90, 5)
    t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=1, total=1, snapshot_id=2, last_seq=1))
    t.send("snapshot", t.msg("snapshot_end", instrument=7, anchor=1, snapshot_id=2), skip=1)
    level_group(t, 3, 1, [(0, 90, 5)])
    for _ in range(3):
        level_group(t, 4, 1, [(0, 90, 5)])
    t.next["snapshot"] += 2  # lost between groups
    level_group(t, 5, 1, [(0, 90, 5)])

    t = tape("overflow")
    for n in range(1, 12):
        level(t, n, 80 + n, 1)
    level_group(t, 2, 11, [(0, 80 + n, 1) for n in range(1, 12)])
    level(t, 12, 95, 1)
    level_group(t, 3, 12, [(0, 80 + n, 1) for n in range(1, 12)] + [(0, 95, 1)])
    for t in tapes.values():
        t.send("mktdata", t.msg("heartbeat"))
    return tapes


def test_level_books_by_life_base_and_time(spark):
    got, others = audits(spark, mbp_tapes(), Settings(window=0, journal=10, empty_start=True))
    assert got == {
        "reset": ["pass"] * 4,
        "gap": ["pass", "pass", "unverifiable/loss", "pass"],
        "mismatch": ["pass", "violation", "pass"],
        "clear": ["pass"] * 3,
        "cold": ["pass", "unverifiable/pending", "pass", "unverifiable/pending", "unverifiable/reorder"],
        "torn": ["pass", "pass", "pass", "pass", "pass", "pass"],
        "overflow": ["pass", "unverifiable/overflow", "pass"],
    }
    assert {k for k, v in others.items() if v} <= {"gap", "cold"} and others["gap"] == {"MBP.DELTA.PERINSTR_DENSITY"}


def test_order_books_by_life_and_time(spark):
    tapes = {}

    def tape(name):
        t = tapes[name] = Tape("mbo")
        t.refdata()
        for _ in range(3):  # so that the reorder window has let the definitions go
            t.send("refdata", t.msg("manifest", valid=1, manifest_seq=1, count=1))
        return t

    t = tape("reset")
    add(t, 1, 1), add(t, 2, 2)
    t.send("mktdata", t.msg("heartbeat"))
    order_group(t, 1, 2, [(1, 100, 10), (2, 100, 10)])
    order_group(t, 2, 2, [(1, 100, 10), (2, 100, 10)])
    t.send("mktdata", t.msg("instrument_reset", instrument=7, anchor=t.next["mktdata"]))
    add(t, 1, 9, 50)
    t.send("mktdata", t.msg("heartbeat"))
    order_group(t, 3, 1, [(9, 50, 10)])
    order_group(t, 4, 1, [(9, 50, 10)])
    t = tape("gap")
    add(t, 1, 1), add(t, 2, 2)
    t.send("mktdata", t.msg("heartbeat"))
    order_group(t, 1, 2, [(1, 100, 10), (2, 100, 10)])
    order_group(t, 2, 2, [(1, 100, 10), (2, 100, 10)])
    add(t, 4, 3)
    t.send("mktdata", t.msg("heartbeat"))
    order_group(t, 3, 4, [(1, 100, 10), (2, 100, 10), (3, 100, 10)])
    order_group(t, 4, 4, [])
    t = tape("runs")  # two different mismatches, one group between that can't be compared, then the same again
    add(t, 1, 1)
    t.send("mktdata", t.msg("heartbeat"))
    for i, rows in enumerate([[(1, 100, 9)], [(1, 100, 10), (5, 1, 1)], [], [(1, 100, 10), (5, 1, 1)], [(1, 100, 10)], [(1, 100, 9)]], 1):
        order_group(t, i, 1 if rows else 3, rows)
    order_group(t, 9, 1, [(1, 100, 10)])
    for t in tapes.values():
        t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=0, total=0, snapshot_id=99, last_seq=0))
    got, _ = audits(spark, tapes)
    assert got == {
        "reset": ["pass"] * 4,
        "gap": ["pass", "pass", "unverifiable/untrusted", "unverifiable/untrusted"],
        "runs": ["suspected", "suspected", "unverifiable/pending", "violation", "pass", "suspected", "pass"],
    }
