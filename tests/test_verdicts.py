"""Tapes with resets that a port skips, lost frames, restarts of reference data and sets that change: what may be said of each."""

from pathlib import Path

from tests.test_engine import BOOKS, Tape
from tickloom import engine
from tickloom.engine import Settings, check
from tickloom.functions.storage import delete


def judged(spark, tapes, settings):
    """(rule, status, reason, instrument) of every tape."""
    feed = next(iter(tapes.values())).feed
    rows = [(name, *row[1:]) for name, t in tapes.items() for row in t.rows]
    found = check(spark.createDataFrame(rows, "capture_id string, arrival bigint, port string, raw binary"), feed, settings)
    out = {name: [] for name in tapes}
    for r in found.select("capture_id", "rule_id", "status", "reason", "instrument").collect():
        if r["capture_id"] in out:
            out[r["capture_id"]].append((r["rule_id"], r["status"] + (f"/{r['reason']}" if r["reason"] else ""), r["instrument"]))
    return out


def of(found, rule, instrument=None):
    return sorted(s for r, s, i in found if r == rule and instrument in (None, i))


def bad(found):
    return sorted({r for r, s, _ in found if s.startswith("violation")})


def level(t, n, qty=5, price=1000, **more):
    t.send("mktdata", t.msg("level_update", instrument=7, source=1, side=0, action=0, per_seq=n, price=price, qty=qty), **more)


def level_group(t, i, k, rows, **more):
    t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=0, total=len(rows), snapshot_id=i, last_seq=k), *(t.msg("snapshot_level", snapshot_id=i, side=0, price=p, qty=q) for p, q in rows), t.msg("snapshot_end", instrument=7, anchor=0, snapshot_id=i), **more)


def start(t, *ports):
    """Numbers of the ports begin anew, as they do in a new era."""
    for p in ports or ("mktdata", "refdata", "snapshot"):
        t.next[p] = 0


def test_eras_of_level_books(spark):
    tapes = {}

    def tape(name):
        tapes[name] = Tape("mbp")
        return tapes[name]

    t = tape("skipped")  # the snapshot port is silent in era 1
    level_group(t, 1, 0, []), level(t, 1), level(t, 2, 6, 1001)
    level_group(t, 2, 2, [(1000, 5), (1001, 6)])
    start(t)
    level(t, 1, 9, 2000, reset=1)
    start(t, "mktdata")
    level_group(t, 3, 0, [], reset=2), level(t, 1, 7, 3000, reset=2)
    level_group(t, 4, 1, [(3000, 7)], reset=2)
    t = tape("wrapped")  # reset counts go on from 255 to 0; a port that comes late is placed by its count
    level(t, 1, reset=254)
    start(t)
    level_group(t, 1, 0, [], reset=1), level(t, 1, 8, reset=1)
    level_group(t, 2, 1, [(1000, 8)], reset=1)
    t = tape("once")  # one reset, seen by two ports: a gap after it is the publisher's
    t.send("refdata", t.msg("heartbeat"))
    level(t, 1, reset=1), level(t, 2, 6, reset=1)
    start(t, "refdata")
    t.send("refdata", t.msg("heartbeat"), reset=1)
    level(t, 9, 7, reset=1)
    t = tape("open group")  # another port's reset doesn't end a group
    t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=0, total=1, snapshot_id=1, last_seq=0), reset=1)
    t.send("refdata", t.msg("heartbeat"))
    start(t, "refdata")
    t.send("refdata", t.msg("heartbeat"), reset=1)
    t.send("snapshot", t.msg("snapshot_level", snapshot_id=1, side=0, price=1000, qty=5), reset=1)
    t.send("snapshot", t.msg("snapshot_end", instrument=7, anchor=0, snapshot_id=1), reset=1)
    t = tape("start")  # without empty_start the first group has nothing to be compared with
    level_group(t, 1, 0, [])
    found = judged(spark, tapes, Settings(window=0, empty_start=True))
    assert of(found["skipped"], BOOKS["mbp"]) == ["pass"] * 4 and not bad(found["skipped"]), found["skipped"]
    assert of(found["wrapped"], BOOKS["mbp"]) == ["pass"] * 2 and not bad(found["wrapped"]), found["wrapped"]
    assert of(found["once"], "MBP.DELTA.PERINSTR_DENSITY") == ["violation"]
    assert of(found["open group"], "MBP.SNAP.GROUP_STRUCTURE") == ["pass"]
    assert of(found["start"], BOOKS["mbp"]) == ["pass"]
    assert of(judged(spark, {"start": tapes["start"]}, Settings(window=0))["start"], BOOKS["mbp"]) == ["unverifiable/cold_start"]


def manifest(t, seq, count, **more):
    t.send("refdata", t.msg("manifest", valid=more.pop("valid", 1), manifest_seq=seq, count=count), **more)


def define(t, seq, *instruments, **more):
    for i in instruments:
        t.send("refdata", t.msg("definition", instrument=i, manifest_seq=seq, price_bound=1), **more)


def order(t, n, order_id, instrument=7, **more):
    t.send("mktdata", t.msg("order_add", instrument=instrument, source=1, side=0, per_seq=n, order_id=order_id, price=100, qty=10), **more)


def order_group(t, i, k, orders, instrument=7, anchor=0, **more):
    rows = [t.msg("snapshot_order", snapshot_id=i, order_id=o, side=0, price=100, qty=10) for o in orders]
    t.send("snapshot", t.msg("snapshot_begin", instrument=instrument, anchor=anchor, total=len(orders), snapshot_id=i, last_seq=k), *rows, t.msg("snapshot_end", instrument=instrument, anchor=anchor, snapshot_id=i), **more)


FOLLOWS, ANCHOR, DANGLING, ROBIN = "RESET.SNAPSHOT_FOLLOWS", "RESET.RECOVERY_SNAPSHOT_ANCHOR_MATCHES_RESET", "RESET.NO_DANGLING_DELTAS_AT_OR_BELOW_ANCHOR", "SNAP.ROUND_ROBIN_COVERS_MANIFEST"


def test_order_books_over_resets_losses_and_sets(spark):
    tapes = {}

    def tape(name, *instruments, seq=1):
        t = tapes[name] = Tape("mbo")
        manifest(t, seq, len(instruments or (7,))), define(t, seq, *(instruments or (7,)))
        return t

    def reset(t, **more):
        t.send("mktdata", t.msg("instrument_reset", instrument=7, anchor=t.next.get("mktdata", 0)), **more)
        return t.next["mktdata"] - 1

    t = tape("skipped")
    order(t, 1, 1), order_group(t, 1, 1, [1])
    start(t)
    order(t, 1, 5, reset=1), order(t, 2, 6, reset=1)
    start(t, "mktdata")
    manifest(t, 1, 1, reset=2), define(t, 1, 7, reset=2)
    order(t, 1, 9, reset=2), order_group(t, 1, 1, [9], reset=2)
    t = tape("recovered")
    order(t, 1, 1)
    at = reset(t)
    order_group(t, 1, 0, [], anchor=at), order(t, 1, 2)
    t = tape("wrong anchor")
    order(t, 1, 1)
    at = reset(t)
    order_group(t, 1, 0, [], anchor=at + 7), order(t, 3, 2)
    t = tape("early")
    order_group(t, 1, 0, []), order(t, 1, 1), reset(t), order(t, 1, 2)
    t = tape("early, snapshot frame lost")
    order_group(t, 1, 0, []), order(t, 1, 1), order_group(t, 3, 1, [1], skip=1), reset(t), order(t, 1, 2)
    t = tape("early, change lost")
    order_group(t, 1, 0, []), order(t, 1, 1), reset(t, skip=1), order(t, 1, 2)
    t = tape("early, no snapshot port")
    order(t, 1, 1), reset(t), order(t, 1, 2)
    t = tape("end")
    order_group(t, 1, 0, []), order(t, 1, 1), reset(t)
    t = tape("end, snapshot frame lost after it")
    order_group(t, 1, 0, [], 8), order(t, 1, 1), reset(t), order_group(t, 3, 0, [], 8, skip=1)
    t = tape("dangling, change lost")
    order(t, 1, 1)
    at = reset(t)
    order_group(t, 1, 0, [], anchor=at), order(t, 4, 2, skip=1)
    t = tape("twice")  # a reset that another follows has no verdict of its own
    order_group(t, 1, 0, []), order(t, 1, 1), reset(t)
    at = reset(t)
    order_group(t, 2, 0, [], anchor=at)
    t = tape("pruned")  # a set without the instrument ends its life; the next one begins unknown
    order(t, 1, 1), order(t, 2, 2), order_group(t, 1, 2, [1, 2])
    manifest(t, 2, 1), define(t, 2, 8)
    manifest(t, 3, 1), define(t, 3, 7)
    order(t, 1, 1), order_group(t, 2, 1, [1])
    t = tape("pruned, middle")
    order(t, 1, 1)
    manifest(t, 2, 1), define(t, 2, 8)
    manifest(t, 3, 1), define(t, 3, 7)
    order(t, 6, 6)
    t = tape("kept")  # a set with it does not
    order(t, 1, 1), manifest(t, 2, 2), define(t, 2, 8, 7), order(t, 3, 2)
    t = tape("rounds", 7, 8)
    order_group(t, 1, 0, []), order_group(t, 2, 0, [])
    t = tape("rounds, lost", 7, 8)
    order_group(t, 1, 0, []), order_group(t, 2, 0, [], skip=1)
    t = tape("one round", 7, 8)
    order_group(t, 1, 0, [])
    t = tapes["no set"] = Tape("mbo")
    manifest(t, 1, 2), define(t, 1, 7), order_group(t, 1, 0, []), order_group(t, 2, 0, [])
    found = judged(spark, tapes, Settings(window=0))
    got = {name: {r: of(f, r) for r in (FOLLOWS, ANCHOR, DANGLING) if of(f, r)} for name, f in found.items()}
    assert of(found["skipped"], BOOKS["mbo"]) == ["pass"] * 2 and not bad(found["skipped"]), found["skipped"]
    assert {n: g for n, g in got.items() if g} == {
        "recovered": {FOLLOWS: ["pass"], ANCHOR: ["pass"], DANGLING: ["pass"]},
        "wrong anchor": {FOLLOWS: ["pass"], ANCHOR: ["violation"], DANGLING: ["violation"]},
        "early": {FOLLOWS: ["violation"]},
        "early, snapshot frame lost": {FOLLOWS: ["unverifiable/loss"]},
        "early, change lost": {FOLLOWS: ["unverifiable/loss"]},
        "early, no snapshot port": {FOLLOWS: ["na"]},
        "end": {FOLLOWS: ["violation"]},
        "end, snapshot frame lost after it": {FOLLOWS: ["unverifiable/loss"]},
        "dangling, change lost": {FOLLOWS: ["pass"], ANCHOR: ["pass"], DANGLING: ["unverifiable/loss"]},
        "twice": {FOLLOWS: ["pass"], ANCHOR: ["pass"]},
    }
    assert not bad(found["pruned"]) and of(found["pruned"], BOOKS["mbo"]) == ["pass"] * 2, found["pruned"]
    assert of(found["pruned, middle"], "DELTA.PERINSTR_FIRST_VALUE") == ["unverifiable/cold_start"] and not of(found["pruned, middle"], "DELTA.PERINSTR_DENSITY")
    assert of(found["kept"], "DELTA.PERINSTR_DENSITY") == ["violation"]
    assert (of(found["rounds"], ROBIN, 7), of(found["rounds"], ROBIN, 8)) == (["pass"], ["violation"])
    assert (of(found["rounds, lost"], ROBIN, 7), of(found["rounds, lost"], ROBIN, 8)) == (["pass"], ["unverifiable/loss"])
    assert of(found["one round"], ROBIN) == ["unverifiable/insufficient_window"] * 2
    assert of(found["no set"], ROBIN) == ["unverifiable/cold_start"]


CADENCE, COVERAGE, BURST, READY, BEAT = "REFDATA.MANIFEST_CADENCE", "REFDATA.DEFINITION_CYCLE_COVERAGE", "REFDATA.NO_BURST_DEFINITIONS", "REFDATA.NEVER_REACHES_READY", "HEARTBEAT.CADENCE"


def test_reference_data_over_resets_losses_and_cycles(spark, monkeypatch):
    tapes = {}

    def tape(name):
        tapes[name] = Tape("tob")
        return tapes[name]

    def quote(t, instrument, **more):
        t.send("mktdata", t.msg("quote", instrument=instrument, source=1, update_flags=3, bid_price=100, bid_qty=1, ask_price=200, ask_qty=1, bid_count=1, ask_count=1), **more)

    t = tape("restart")  # numbers begin anew after a reset, and quotes are judged by the new set
    manifest(t, 4, 1), define(t, 4, 7), manifest(t, 5, 1), define(t, 5, 7), quote(t, 7)
    start(t)
    quote(t, 7, reset=1)  # the reference data port has not reset yet
    manifest(t, 1, 1, reset=1)
    quote(t, 7, reset=1)  # no set is complete
    define(t, 1, 8, reset=1), manifest(t, 1, 1, reset=1), define(t, 1, 8, reset=1)
    quote(t, 7, reset=1), quote(t, 8, reset=1)
    t = tape("cleared")  # likewise after a manifest that is not valid
    manifest(t, 9, 1), define(t, 9, 7), manifest(t, 0, 0, valid=0), quote(t, 7), manifest(t, 1, 1), define(t, 1, 8), quote(t, 7), quote(t, 8)
    t = tape("late")
    manifest(t, 1, 1, ts=0), manifest(t, 1, 1, ts=300)
    t = tape("late, lost")
    manifest(t, 1, 1, ts=0), manifest(t, 1, 1, ts=300, skip=3)
    t = tape("late, lost before the reset")
    manifest(t, 1, 1, ts=0), manifest(t, 1, 1, ts=50, skip=3)
    start(t)
    manifest(t, 1, 1, ts=60, reset=1), manifest(t, 1, 1, ts=360, reset=1)
    t = tape("beats")
    t.send("mktdata", t.msg("heartbeat"), ts=0), t.send("mktdata", t.msg("heartbeat"), ts=300), t.send("mktdata", t.msg("heartbeat"), ts=350)
    t = tape("beats, lost")
    t.send("mktdata", t.msg("heartbeat"), ts=0), t.send("mktdata", t.msg("heartbeat"), ts=300, skip=2)

    def cycle(name, *sent, close=400, **more):
        """A set of two established by 150, definitions (ts, instrument) after it, and the closing manifest."""
        t = tape(name)
        manifest(t, 1, 2, ts=0), define(t, 1, 1, ts=20), define(t, 1, 2, ts=40), manifest(t, 1, 2, ts=150)
        for ts, instrument in sent:
            define(t, 1, instrument, ts=ts)
        manifest(t, 1, 2, ts=close, **more)
        return t

    cycle("incomplete", (200, 1))
    cycle("complete", (200, 1), (300, 2))
    cycle("one twice", (200, 1), (300, 1))
    cycle("burst", (200, 1), (200, 2))
    cycle("incomplete, lost", (200, 1), skip=2)
    cycle("open", (200, 1), close=240)
    t = tape("bootstrap")  # the first cycle closes before the set is complete
    manifest(t, 1, 2, ts=0), define(t, 1, 1, ts=10), manifest(t, 1, 2, ts=120), define(t, 1, 2, ts=130), manifest(t, 1, 2, ts=230)
    t = tape("bump")  # a cycle is judged by the set that stood before the manifest that closes it
    manifest(t, 1, 1, ts=0), define(t, 1, 1, ts=10), manifest(t, 1, 1, ts=110), define(t, 1, 1, ts=120), manifest(t, 2, 1, ts=220), define(t, 2, 2, ts=230), manifest(t, 2, 1, ts=330)
    t = tape("never")
    manifest(t, 1, 2, ts=0), define(t, 1, 1, ts=10), manifest(t, 1, 2, ts=90), manifest(t, 1, 2, ts=400)
    t = tape("no manifest")
    define(t, 1, 1, ts=10)
    gone = []
    monkeypatch.setattr(engine, "delete", lambda spark, paths: (gone.extend(paths), delete(spark, paths)))
    found = judged(spark, tapes, Settings(window=0, manifest_cadence=100, definition_cycle=100, heartbeat=100))
    assert len(gone) > 5 and not any(Path(p.removeprefix("file:")).exists() for p in gone)  # tables that findings need no longer
    known = "TOB.QUOTE.REFDATA_KNOWN"
    assert not [r for r in bad(found["restart"]) if r not in (known,)], found["restart"]
    assert (of(found["restart"], known, 7), of(found["restart"], known, 8)) == (["na", "pass", "pass", "violation"], ["pass"])
    assert bad(found["cleared"]) == ["REFDATA.VALID_FLAG_WHILE_SERVING", known]
    assert (of(found["cleared"], known, 7), of(found["cleared"], known, 8)) == (["na", "violation"], ["pass"])
    assert (of(found["late"], CADENCE), of(found["late, lost"], CADENCE), of(found["late, lost before the reset"], CADENCE)) == (["violation"], ["unverifiable/loss"], ["violation"])
    assert (of(found["beats"], BEAT), of(found["beats, lost"], BEAT)) == (["violation"], ["unverifiable/loss"])
    # The first cycle of these tapes, 0 to 150, is complete.
    assert {n: (of(found[n], COVERAGE), of(found[n], BURST)) for n in ("incomplete", "complete", "one twice", "burst", "incomplete, lost", "open")} == {
        "incomplete": (["pass", "violation"], ["pass", "unverifiable/superseded"]),
        "complete": (["pass", "pass"], ["pass", "pass"]),
        "one twice": (["pass", "violation"], ["pass", "unverifiable/superseded"]),
        "burst": (["pass", "pass"], ["pass", "violation"]),
        "incomplete, lost": (["pass", "unverifiable/loss"], ["pass", "unverifiable/superseded"]),
        "open": (["pass"], ["pass"]),
    }
    assert of(found["bootstrap"], COVERAGE) == ["unverifiable/cold_start", "violation"]
    assert of(found["bump"], COVERAGE) == ["pass", "pass", "pass"] and of(found["bump"], BURST) == ["na"] * 3
    assert (of(found["never"], READY), of(found["no manifest"], READY), of(found["complete"], READY)) == (["violation"], ["unverifiable/cold_start"], ["pass"])
    assert of(found["late"], READY) == ["unverifiable/cold_start"] or of(found["late"], READY) == ["violation"]
