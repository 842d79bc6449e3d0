"""The streaming subscriber says what the batch engine says, over all level tapes and across restarts."""

from tests.test_engine import mbp_tapes
from tests.test_verdicts import level, level_group, start
from tests.test_engine import Tape
from tickloom.engine import Settings, check
from tickloom.streaming import subscriber as sub

SCHEMA = "capture_id string, arrival bigint, port string, raw binary"


def tapes():
    out = mbp_tapes()
    t = out["skipped"] = Tape("mbp")
    t.refdata()
    level_group(t, 1, 0, []), level(t, 1), level_group(t, 2, 1, [(1000, 5)])
    start(t)
    level(t, 1, 9, 2000, reset=1)
    start(t, "mktdata")
    level_group(t, 3, 0, [], reset=2), level(t, 1, 7, 3000, reset=2), level_group(t, 4, 1, [(3000, 8)], reset=2)
    t = out["groups"] = Tape("mbp")  # groups that are cut, torn, short, of a wrong id
    begin = lambda i, **more: t.send("snapshot", t.msg("snapshot_begin", instrument=7, anchor=0, total=1, snapshot_id=i, last_seq=0), **more)
    row = lambda i, **more: t.send("snapshot", t.msg("snapshot_level", snapshot_id=i, side=0, price=1, qty=1), **more)
    end = lambda i, **more: t.send("snapshot", t.msg("snapshot_end", instrument=7, anchor=0, snapshot_id=i), **more)
    begin(1), begin(2), row(2), end(2), begin(3), end(3), begin(4), end(4, skip=1), begin(5), row(9), end(5), begin(6), row(6), end(6)
    return out


def test_subscriber_equals_the_engine_across_a_restart(spark, tmp_path):
    made = tapes()
    # Tapes run side by side: arrivals are of one clock, so that each stop comes in the middle of every tape.
    rows = [(str(name), i, port, raw) for name, t in made.items() for _, i, port, raw in t.rows]
    half = {name: len(t.rows) // 2 for name, t in made.items()}
    spool, mid, out = (str(tmp_path / x) for x in ("spool", "mid", "out"))
    for part in (False, True):
        spark.createDataFrame([r for r in rows if (r[1] >= half[r[0]]) == part], SCHEMA).coalesce(1).write.mode("append").parquet(spool)
        # A new query each time, from the checkpoint of the one before.
        for source, schema, stream, target in ((spool, SCHEMA, lambda s: sub.sequence(s, 0), mid), (mid, sub.SEQUENCED, lambda s: sub.follow(s, 10, True), out)):
            made_by = stream(spark.readStream.schema(schema).parquet(source))
            made_by.writeStream.format("parquet").option("path", target).option("checkpointLocation", target + "-at").trigger(availableNow=True).start().awaitTermination()
    rules = [sub.GROUPS, sub.BOOKS, sub.DENSITY, sub.RESTART]
    found = check(spark.createDataFrame(rows, SCHEMA), "mbp", Settings(window=0, journal=10, empty_start=True)).where(f"rule_id in {tuple(rules)}")
    key = lambda r: (r["capture_id"], r["rule_id"], r["seq"], r["status"], r["reason"] or "")
    want = sorted(key(r) for r in found.collect() if r["capture_id"] in made)
    got = sorted(key(r) for r in spark.read.schema(sub.VERDICTS).parquet(out).collect())
    assert got == want
    assert {r[3] for r in got if r[1] == sub.BOOKS} == {"pass", "violation", "unverifiable"} and {r[3] for r in got if r[1] == sub.GROUPS} == {"pass", "violation", "unverifiable"}
    states = spark.read.schema(sub.SEQUENCED).parquet(mid).where("kind = 'refdata' and capture_id = 'reset'").orderBy("at").collect()
    assert [r["fact"] for r in states] == ['{"state": "collecting"}', '{"state": "ready"}']


def test_reordered_frames_leave_in_order():
    p = sub.Port(2)
    left = [x[:3] for seq in (0, 2, 1, 4, 7, 5, 5, 9, 8, 3) for x in p.push((seq, seq, 0, []), 1, None)]
    assert left == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 4, 1), (0, 5, 0), (0, 7, 1), (0, 3, 0)][: len(left)]
    p = sub.Port(0, p.state() | {"heap": []})
    assert [x[0] for x in p.push((0, 0, 0, []), 4, None)] == [3] and not list(p.push((1, 0, 0, []), 3, None))
