"""A tape for each rule that needs state: the fault gives its finding, and the conformant tape gives none."""

import struct

from tests.test_engine import Tape, run_all, violations
from tickloom.engine import Settings


def add(t, n, order_id=1, side=0, price=100, qty=10, **more):
    t.send("mktdata", t.msg("order_add", **({"instrument": 7, "source": 1, "side": side, "per_seq": n, "order_id": order_id, "price": price, "qty": qty} | more)))


def execute(t, n, order_id=1, qty=1, **more):
    t.send("mktdata", t.msg("order_execute", **({"instrument": 7, "source": 1, "aggressor": 2, "per_seq": n, "order_id": order_id, "trade_id": 5, "price": 100, "qty": qty} | more)))


def group(t, i, k, orders=(), total=None, anchor=0, end=None, **more):
    rows = [t.msg("snapshot_order", snapshot_id=more.get("row_id", i), order_id=o, side=0, price=p, qty=q) for o, p, q in orders]
    begin = t.msg("snapshot_begin", instrument=more.get("instrument", 7), anchor=anchor, total=len(rows) if total is None else total, snapshot_id=i, last_seq=k)
    ends = [] if end == "none" else [t.msg("snapshot_end", instrument=more.get("instrument", 7), anchor=anchor if end is None else end, snapshot_id=i)]
    t.send("snapshot", begin, *rows, *ends)


def at(t, ts):
    """Sets the clock of the tape's last frame."""
    t.rows[-1][3][12:20] = struct.pack("<Q", ts)


def boundary(t, number):
    t.send("mktdata", t.msg("batch_boundary", batch_id=number))


def reset(t, anchor=None):
    t.send("mktdata", t.msg("instrument_reset", instrument=7, anchor=t.next["mktdata"] if anchor is None else anchor))


ONE = [(1, 100, 10)]
ORDER_TAPES = {
    "DELTA.PERINSTR_FIRST_VALUE": lambda t: (reset(t), add(t, 3)),
    "DELTA.PERINSTR_NO_SNAPSHOT_RESET": lambda t: (add(t, 2, 2), add(t, 1, 3)),
    "DELTA.PERINSTR_DUP_DIVERGENT": lambda t: (add(t, 2, 2), add(t, 2, 3)),
    "DELTA.PERINSTR_WRAP_BEFORE_RESET": lambda t: (add(t, 4294967295, 2), add(t, 0, 3)),
    "FRAME.MKTDATA_SEQ_START": lambda t: t.send("mktdata", t.msg("heartbeat"), skip=2, reset=1),
    "FRAME.SEQ_RESET_GAP": lambda t: (t.send("mktdata", t.msg("heartbeat"), skip=4), t.next.update(mktdata=3), t.send("mktdata", t.msg("heartbeat"))),
    "FRAME.SEQ_DUP_DIVERGENT": lambda t: (t.next.update(mktdata=0), t.send("mktdata", t.msg("heartbeat"))),
    "FRAME.SEND_TS_MONOTONIC": lambda t: (t.send("mktdata", t.msg("heartbeat")), at(t, 5)),
    "BATCH.ID_MONOTONIC": lambda t: (boundary(t, 5), boundary(t, 4)),
    "REF.EXEC_DANGLING_ORDER": lambda t: execute(t, 2, 99),
    "REF.DUPLICATE_LIVE_ORDERADD": lambda t: add(t, 2, 1),
    "REF.SIDE_PRICE_CONSISTENCY": lambda t: execute(t, 2, aggressor=1),
    "FIELD.SOURCE_ID_CONSISTENCY": lambda t: execute(t, 2, source=2),
    "TRADE.EXEC_GROUPING": lambda t: t.send("mktdata", t.msg("trade", instrument=7, source=1, aggressor=1, price=100, qty=1, trade_id=77)),
    "REF.FULLFILL_FLAG_DISAGREEMENT": lambda t: execute(t, 2, qty=4, exec_flags=1),
    "BATCH.ATOMICITY_CONSISTENCY": lambda t: (execute(t, 2, qty=10), boundary(t, 1)),
    "REF.EXEC_PRICE_BOUND": lambda t: execute(t, 2, price=-5),
    "SNAP.ORDER_PRICE_BOUND": lambda t: group(t, 1, 1, [(1, -5, 10)]),
    "SNAP.BEGIN_ORDER_END_GROUPING": lambda t: (group(t, 1, 1, ONE, end="none"), group(t, 2, 1, ONE)),
    "SNAP.TOTAL_ORDERS_COUNT_MATCH": lambda t: group(t, 1, 1, ONE, total=2),
    "SNAP.END_FIELDS_MATCH_BEGIN": lambda t: group(t, 1, 1, ONE, end=9),
    "SNAP.ORDER_SNAPSHOT_ID_MATCH": lambda t: group(t, 1, 1, ONE, row_id=8),
    "SNAP.SNAPSHOT_ORDER_NO_DUP_ORDER_ID": lambda t: group(t, 1, 1, ONE * 2),
    "SNAP.EMPTY_BOOK_WELL_FORMED": lambda t: group(t, 1, 1, ONE, total=0),
    "SNAP.ANCHOR_IS_MKTDATA_SEQ": lambda t: group(t, 1, 1, ONE, anchor=1000),
    "SNAP.ANCHOR_MONOTONIC_PER_INSTRUMENT": lambda t: (boundary(t, 1), group(t, 1, 1, ONE, anchor=1), group(t, 2, 1, ONE, anchor=0)),
    "SNAP.SNAPSHOT_ID_MONOTONIC": lambda t: (group(t, 1, 1, ONE), group(t, 1, 1, ONE)),
    "SNAP.LAST_INSTRUMENT_SEQ_CONSISTENT_WITH_DELTAS": lambda t: group(t, 1, 9, ONE),
    "SNAP.ROUND_ROBIN_COVERS_MANIFEST": lambda t: (group(t, 1, 0, instrument=8), group(t, 2, 0, instrument=8)),
    "RESET.SNAPSHOT_FOLLOWS": lambda t: reset(t),
    "RESET.RECOVERY_SNAPSHOT_ANCHOR_MATCHES_RESET": lambda t: (reset(t), group(t, 1, 0, anchor=0)),
    "RESET.NO_DANGLING_DELTAS_AT_OR_BELOW_ANCHOR": lambda t: (reset(t), group(t, 1, 5, ONE, anchor=t.next["mktdata"] - 1), add(t, 9, 2)),
    "RESET.ANCHOR_SEQ_IS_CURRENT_FRAME": lambda t: reset(t, 1000),
}


def test_rules_of_the_order_feed(spark):
    tapes = {}
    for rule, fault in [(None, lambda t: (group(t, 1, 1, ONE), group(t, 2, 1, ONE))), *ORDER_TAPES.items()]:
        t = tapes[rule] = Tape("mbo")
        t.send("refdata", t.msg("manifest", valid=1, manifest_seq=1, count=2 if rule == "SNAP.ROUND_ROBIN_COVERS_MANIFEST" else 1))
        for instrument in (7, 8)[: 2 if rule == "SNAP.ROUND_ROBIN_COVERS_MANIFEST" else 1]:
            t.send("refdata", t.msg("definition", instrument=instrument, manifest_seq=1, price_bound=1))
        add(t, 1)
        fault(t)
    found = run_all(spark, tapes, Settings(window=0))
    assert violations(found[None]) == [] and ("SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "pass") in found[None]
    assert ("SNAP.ANCHOR_LE_OR_GT_LAST_APPLIED_HANDLING", "pass") in found[None]
    missed = {rule: found[rule] for rule in ORDER_TAPES if (rule, "violation") not in found[rule] and (rule, "na") not in found[rule]}
    assert not missed


def manifest(t, seq=1, count=1, valid=1, ts=None):
    t.send("refdata", t.msg("manifest", valid=valid, manifest_seq=seq, count=count))
    if ts is not None:
        at(t, ts)


def define(t, instrument=7, seq=1, ts=None):
    t.send("refdata", t.msg("definition", instrument=instrument, manifest_seq=seq))
    if ts is not None:
        at(t, ts)


REFERENCE_TAPES = {
    "REFDATA.MANIFEST_CADENCE": lambda t: manifest(t, ts=1900),
    "REFDATA.DEFINITION_CYCLE_COVERAGE": lambda t: (define(t, ts=1100), manifest(t, ts=1210), manifest(t, ts=1350)),  # two cycles of 100 without one
    "REFDATA.NO_BURST_DEFINITIONS": lambda t: (define(t, 8, ts=1001), define(t, 9, ts=1001), manifest(t, ts=1110)),
    "REFDATA.NEVER_REACHES_READY": lambda t: (manifest(t, 2, 9, ts=1400), define(t, 7, 2, ts=1500)),
    "REFDATA.COUNT_VS_DISTINCT_DEFS": lambda t: (define(t, 7), define(t, 8), define(t, 9), define(t, 10)),
    "REFDATA.SET_CHANGE_NO_SEQ_BUMP": lambda t: (define(t, 7), define(t, 8), define(t, 9), define(t, 10)),
    "REFDATA.COUNT_CHANGE_NO_SEQ_BUMP": lambda t: manifest(t, 1, 5),
    "REFDATA.STALE_SEQ_TAG_AFTER_BUMP": lambda t: define(t, 7, 4),
    "REFDATA.VALID_FLAG_WHILE_SERVING": lambda t: (define(t, 7), define(t, 8), define(t, 9), manifest(t, valid=0)),
    "REFDATA.SEQ_MONOTONIC_NO_REGRESS": lambda t: (manifest(t, 5, 3), manifest(t, 4, 3)),
    "REFDATA.SEQ_BUMP_NOT_BY_ONE": lambda t: manifest(t, 4, 3),
    "REFDATA.MANIFEST_SEQ_NONZERO_WHEN_VALID": lambda t: manifest(t, 0, 3),
    "MANIFEST.STATE_MACHINE": lambda t: manifest(t, valid=3),
}


def test_rules_of_reference_data(spark):
    tapes = {}
    for rule, fault in REFERENCE_TAPES.items():
        t = tapes[rule] = Tape("mbp")
        n = 1 if rule == "REFDATA.DEFINITION_CYCLE_COVERAGE" else 3
        if rule not in ("REFDATA.NEVER_REACHES_READY", "REFDATA.MANIFEST_SEQ_NONZERO_WHEN_VALID"):
            manifest(t, 1, n)
        if rule in ("REFDATA.NO_BURST_DEFINITIONS", "REFDATA.DEFINITION_CYCLE_COVERAGE"):
            define(t, 7, ts=1001)
        if rule == "REFDATA.NEVER_REACHES_READY":
            manifest(t, 2, 9, ts=1000)
        fault(t)
        t.send("mktdata", t.msg("heartbeat"))
    found = run_all(spark, tapes, Settings(window=0, manifest_cadence=300, definition_cycle=100))
    missed = {rule: found[rule] for rule in REFERENCE_TAPES if (rule, "violation") not in found[rule]}
    assert not missed


def test_numbering_of_the_level_feed(spark):
    t = Tape("mbp")
    t.refdata()
    update = lambda n: t.send("mktdata", t.msg("level_update", instrument=7, source=1, side=0, action=0, per_seq=n, price=90 + n, qty=1))
    update(1), update(2)
    t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=0, total=0, snapshot_id=1, last_seq=2), t.msg("snapshot_end", instrument=7, anchor=0, snapshot_id=1))
    update(1)
    assert violations(t.run(spark, Settings(window=0))) == ["MBP.DELTA.PERINSTR_NO_SNAPSHOT_RESET"]


def test_an_overfill_leaves_its_order(spark):
    tapes = {}
    for name, more in (("over", ()), ("full", (1,))):
        t = tapes[name] = Tape("mbo")
        manifest(t)
        define(t)
        add(t, 1, 1), add(t, 2, 2)
        execute(t, 3, 1, 4)
        execute(t, 4, 1, 9, **({"exec_flags": 1} if more else {}))
        execute(t, 5, 1 if not more else 2, 2)
        group(t, 1, 5, [(1, 100, 4), (2, 100, 10)] if not more else [(2, 100, 8)])
    found = run_all(spark, tapes, Settings(window=0))
    for name in tapes:
        assert found[name].count(("REF.EXEC_OVERFILL", "violation")) == 1 and violations(found[name]) == ["REF.EXEC_OVERFILL"]
        assert ("SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "pass") in found[name]
