import heapq
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import derived, findings, levels, orders, snapshots
from tickloom.operators import ordered as o
from tickloom.operators.refdata import accepted_manifests, price_bound
from tickloom.plans import feeds
from tickloom.streaming.replay import Sequencer, replay_batch


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_eras(spark):
    counts = [250, 250, 255, 3, 254, 3, 131, 130, 4]
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate(counts)], "port string, arrival bigint, reset_count bigint")
    got = rows(o.with_eras(df, ["port"]), "arrival", "era_no", "era_state")
    want = ["same", "same", "newer", "newer", "older", "same", "ambiguous", "newer", "older"]
    assert [g[2] for g in got] == want
    assert [g[1] for g in got] == [0, 0, 1, 2, 2, 2, 2, 3, 3]


def test_asof_backward_strict_and_forward(spark):
    dims = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b")], "k string, pos bigint, v string")
    facts = spark.createDataFrame([("k", p) for p in (1, 2, 3, 5, 9)], "k string, pos bigint")
    assert [r[1] for r in rows(o.asof(facts, dims, ["k"], "pos", ["v"]), "pos", "v")] == [None, "a", "a", "b", "b"]
    assert [r[1] for r in rows(o.asof(facts, dims, ["k"], "pos", ["v"], strict=True), "pos", "v")] == [None, None, "a", "a", "b"]
    assert [r[1] for r in rows(o.asof(facts, dims, ["k"], "pos", ["v"], forward=True), "pos", "v")] == ["a", "a", "b", "b", None]
    assert [r[1] for r in rows(o.asof(facts, dims, ["k"], "pos", ["v"], strict=True, forward=True), "pos", "v")] == ["a", "b", "b", None, None]


def test_run_length(spark):
    values = ["x", "x", None, "x", "y", "y", "", "y"]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i bigint, signature string")
    got = [r[1] for r in rows(snapshots.oracle_status(df, ["k"], "i"), "i", "status")]
    assert got == ["suspected", "violation", "unverifiable", "suspected", "suspected", "violation", "pass", "suspected"]


def replayed_ladder(steps):
    book = {}
    for kind, side, price, x in steps:
        if kind == "u":
            book[side, price] = x
        else:
            clear_side, scope = x
            for s, p in list(book):
                if clear_side in (2, s) and (scope == 0 or (s == 0 and p <= price) or (s == 1 and p >= price)):
                    book[s, p] = 0
    return sorted((s, p, q) for (s, p), q in book.items() if q)


@pytest.mark.parametrize("seed", range(4))
def test_ladder_equals_replay(spark, seed):
    rng = random.Random(seed)
    steps = [("u", rng.randrange(2), rng.randrange(8), rng.randrange(4)) if rng.random() < 0.85 else ("c", None, rng.randrange(8), (rng.randrange(3), rng.randrange(2))) for _ in range(120)]
    steps = [s if s[0] == "u" or s[3] != (2, 1) else ("u", 0, 1, 1) for s in steps]
    u = spark.createDataFrame([(1, i, s[1], s[2], s[3]) for i, s in enumerate(steps, 1) if s[0] == "u"], "instrument int, per_seq bigint, side int, price bigint, qty bigint")
    c = spark.createDataFrame([(1, i, s[3][0], s[3][1], s[2]) for i, s in enumerate(steps, 1) if s[0] == "c"], "instrument int, per_seq bigint, clear_side int, scope int, from_price bigint")
    assert rows(levels.ladder(u, ["instrument"], c), "side", "price", "qty") == replayed_ladder(steps)
    k = spark.createDataFrame([(1, x) for x in (0, 30, 77, 120)], "instrument int, k bigint")
    got = rows(levels.ladder_asof(u, k, ["instrument"], c), "k", "side", "price", "qty")
    assert got == sorted((x, *r) for x in (0, 30, 77, 120) for r in replayed_ladder(steps[:x]))


def test_order_lives(spark):
    e = [(1, "add", 7, 10, None, None), (2, "execute", 7, 4, 1, False), (3, "execute", 7, 6, 1, True), (4, "execute", 7, 1, 1, False), (5, "add", 7, 5, None, None), (6, "execute", 7, 9, 2, False), (7, "cancel", 8, 0, None, None), (8, "add", 7, 5, None, None), (9, "execute", 7, 3, 2, True)]
    df = spark.createDataFrame([("i", p, k, oid, q, 0, 100, 1, a, f) for p, k, oid, q, a, f in e], "instrument string, pos bigint, kind string, order_id bigint, qty bigint, side int, price bigint, source int, aggressor int, full_fill boolean")
    lives = orders.with_lifecycle(df, ["instrument"])
    assert rows(orders.after_removal(lives), "pos") == [(4,)]
    assert rows(orders.dangling(lives, "cancel"), "pos") == [(7,)]
    assert rows(orders.duplicate_adds(lives, ["instrument"]), "pos") == [(8,)]
    assert rows(orders.quantities(lives).where("overfill"), "pos", "remaining") == [(6, 5)]
    assert rows(orders.quantities(lives).where("disagree"), "pos") == [(9,)]
    assert rows(orders.wrong_side(lives), "pos") == [(2,), (3,), (4,)]
    assert orders.live_at(df, ["instrument"], F.lit(8)).count() == 1


def test_order_lives_are_sorted_once(spark, capsys):
    """Lives, what they leave and the add before: all of one order's rows by position."""
    df = spark.range(10).selectExpr("id % 2 as instrument", "id as pos", "'add' as kind", "id as order_id", "id as qty", "0 as side", "id as price", "1 as source", "false as full_fill")
    orders.duplicate_adds(orders.with_lifecycle(df, ["instrument"]), ["instrument"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1


def test_order_lives_of_quantities_beyond_a_word_in_all(spark):
    df = spark.createDataFrame([(p, "add" if p % 2 else "execute", 1 << 62) for p in range(1, 7)], "pos bigint, kind string, qty bigint")
    df = df.selectExpr("1 as instrument", "7 as order_id", "*", "0 as side", "1 as price", "1 as source", "false as full_fill")
    assert rows(orders.with_lifecycle(df, ["instrument"]), "pos", "filled") == [(p, 0) for p in range(1, 7)]


@pytest.mark.parametrize("begins", [0, 1, 3, 700])
def test_islands_by_slices_equal_those_by_one_window(spark, begins, capsys):
    """Also before the first begin, of a key without any, and where many begins share a slice."""
    n = 3000
    df = spark.range(n).selectExpr("id % 2 as k", "id * id as pos", f"id % 2 = 0 and id >= 100 and id % {n // begins if begins else n} < 2 and {begins} > 0 as b").unionByName(spark.createDataFrame([(9, 5, False)], "k bigint, pos bigint, b boolean"))
    from tickloom.operators.ordered import with_islands

    got = with_islands(df, ["k"], F.col("b"), ["pos"], at=F.col("pos"), tasks=5)
    assert rows(got, "k", "pos", "island") == rows(with_islands(df, ["k"], F.col("b"), ["pos"]), "k", "pos", "island")
    got.explain()
    assert "Window [sum(" in (plan := capsys.readouterr().out) and "[k#" in plan and ", __slice#" in plan


def test_snapshot_groups_by_slices(spark):
    """A begin's rows, a key repeated before and after the end, an id that differs, an end that differs, rows before any begin."""
    e = [(1, "row", 1, None, 5), (2, "begin", 1, 3, None), (3, "row", 1, None, 5), (4, "row", 2, None, 5), (5, "row", 1, None, None), (6, "end", 1, None, None), (7, "row", 1, None, 6), (8, "begin", 2, 0, None), (9, "end", 3, None, None)]
    df = spark.createDataFrame([("c", p, k, i, 7, 0, t, x) for p, k, i, t, x in e], "c string, pos bigint, kind string, snapshot_id bigint, instrument bigint, anchor bigint, total bigint, key bigint")
    for more in ({}, {"at": F.col("pos"), "tasks": 3}):
        g = snapshots.groups(df, ["c"], **more)
        assert rows(g.where("island > 0"), "island", "snapshot_id", "total", "received", "duplicates", "wrong_id", "ended", "end_differs", "orphans", "begin_pos") == [(1, 1, 3, 3, 2, 1, True, False, 1, 2), (2, 2, 0, 0, 0, 0, True, True, 0, 8)]
        assert rows(g.where("island = 0"), "received", "orphans", "begin_pos", "ended") == [(0, 1, 1, False)]
        assert rows(snapshots.repeated_keys(df, ["c"], **more), "island", "snapshot_id", "key", "n") == [(1, 1, 5, 2)]


def test_feeds_are_dealt_by_rows_however_many_partitions_the_session_has(spark, monkeypatch):
    # Adaptive execution joins the session's partitions by bytes, so that many of them still make few, large tasks.
    monkeypatch.setattr(feeds, "TASK_ROWS", 100)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        lines = feeds.lineitem(spark, "/root/testdata/sf0.001")
        sizes = [r[0] for r in lines.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) > 30 and max(sizes) < 300
        assert feeds.tasks(spark, 300) is None  # no more than the cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_manifests(spark):
    m = [(1, 10, 5), (1, 10, 6), (1, 11, 5), (1, 14, 5), (1, 12, 5), (2, 15, 5), (0, 15, 5), (1, 15, 0), (1, 65535, 4), (1, 15, 5)]
    df = spark.createDataFrame([("c", i, i, *x) for i, x in enumerate(m)], "channel_id string, pos bigint, send_ts bigint, valid bigint, manifest_seq bigint, count bigint")
    got = {r["pos"]: (r["accepted"], r["rules"]) for r in accepted_manifests(df, ["channel_id"]).collect()}
    assert got[1] == (True, ["REFDATA.COUNT_CHANGE_NO_SEQ_BUMP"])
    assert got[2] == (True, []) and got[3] == (True, ["REFDATA.SEQ_BUMP_NOT_BY_ONE"])
    assert got[4] == (False, ["REFDATA.SEQ_MONOTONIC_NO_REGRESS"]) and got[5] == (False, ["MANIFEST.STATE_MACHINE"])
    assert got[6] == (False, []) and got[7] == (False, ["REFDATA.MANIFEST_SEQ_NONZERO_WHEN_VALID"])
    assert got[8] == (False, ["REFDATA.SEQ_MONOTONIC_NO_REGRESS"]) and got[9] == (True, [])


def test_wrap_to_zero_is_legal(spark):
    df = spark.createDataFrame([("c", 0, 1, 65535, 5), ("c", 1, 1, 0, 5)], "channel_id string, pos bigint, valid bigint, manifest_seq bigint, count bigint")
    assert [r["rules"] for r in accepted_manifests(df, ["channel_id"]).collect()] == [[], []]


def test_price_bound(spark):
    df = spark.createDataFrame([(1, -1), (2, 5), (0, -1), (None, -1)], "price_bound int, price bigint")
    assert [r["status"] for r in price_bound(df, "price").collect()] == ["violation", "pass", "na", "unverifiable"]


def test_grading(spark):
    df = spark.createDataFrame([("HEARTBEAT.CADENCE", "violation", True), ("FRAME.MAGIC_MISMATCH", "violation", True), ("FIELD.SIDE_ENUM", "violation", True), ("FIELD.SIDE_ENUM", "violation", False)], "rule_id string, status string, future boolean")
    got = rows(findings.graded(df, future=F.col("future")), "rule_id", "severity", "status")
    assert got == [("FIELD.SIDE_ENUM", "info", "na"), ("FIELD.SIDE_ENUM", "should", "violation"), ("FRAME.MAGIC_MISMATCH", "must", "violation"), ("HEARTBEAT.CADENCE", "info", "na")]
    assert findings.exit_code(findings.graded(df.where("rule_id like 'FIELD%'")), strict=True).first()[0] == 1
    assert findings.exit_code(findings.graded(df.where("rule_id like 'FIELD%'"))).first()[0] == 0


def test_scaling(spark):
    df = spark.createDataFrame([(12345, -3), (7, 2), (-5, 0)], "raw bigint, e int")
    assert [str(r[0].normalize()) for r in df.select(derived.scaled(F.col("raw"), F.col("e"))).collect()] == ["12.345", "7E+2", "-5"]


def random_tape(seed, n=300):
    rng = random.Random(seed)
    tape, seq, reset = [], 0, 0
    for i in range(n):
        if rng.random() < 0.01:
            seq, reset = 0, reset + 1
        if rng.random() > 0.03:
            tape.append((i * 10, seq, reset % 256, i, seq))
            if rng.random() < 0.05:
                tape.append((i * 10 + 5, seq, reset % 256, i, seq + (10**6 if rng.random() < 0.5 else 0)))
        seq += 1
    return tape


@pytest.mark.parametrize("seed", range(3))
def test_relational_sequencing_equals_replay(spark, seed):
    """On tapes without disorder, the windows and the state machine agree on gaps and divergent copies."""
    tape = random_tape(seed)
    df = spark.createDataFrame([("c", 1, "mktdata", *t) for t in tape], "capture_id string, channel_id bigint, port string, arrival bigint, seq bigint, reset_count bigint, send_ts bigint, payload bigint")
    got = replay_batch(df)
    eras = o.with_eras(df, ["channel_id"]).where("era_state in ('same', 'newer')")
    d = o.with_duplicates(eras, ["channel_id", "era_no", "seq"], "payload")
    assert rows(got.where("rule_id = 'FRAME.SEQ_DUP_DIVERGENT'"), "era_no", "seq") == rows(d.where("divergent"), "era_no", "seq")
    gaps = o.with_gaps(d.where("copy_no = 0"), ["channel_id", "era_no"], "seq", ["seq"]).where("missing > 0")
    assert rows(got.where("rule_id = 'FRAME.GAP'"), "era_no", "seq") == rows(gaps, "era_no", "seq")


def test_replay_holds_no_key_whole():
    """Findings come batch by batch while a key goes on; a key that ends inside a batch is flushed there."""
    import pyarrow as pa

    from tickloom.streaming.replay import _replayed

    read = 0

    def batches():
        nonlocal read
        for channel, start in ((1, 0), (1, 100), (2, 0)):
            read += 1
            n = range(start, start + 100)
            yield pa.RecordBatch.from_pydict({"capture_id": ["c"] * 100, "channel_id": [channel] * 100, "port": ["mktdata"] * 100, "arrival": list(n), "seq": [x * 2 for x in n], "reset_count": [0] * 100, "send_ts": list(n), "payload": list(n)})

    seen = [(read, b.num_rows) for b in _replayed(batches(), 8)]
    assert seen == [(1, 91), (2, 100), (3, 8 + 91), (3, 8)]


def test_sequencer_state_survives(spark):
    tape = random_tape(9)
    whole = Sequencer()
    want = [f for t in tape for f in whole.push(*t)]
    state, got = None, []
    for t in tape:
        s = Sequencer(state=state)
        got += list(s.push(*t))
        state = s.state()
    assert got == want


def test_ladders_at_points_over_the_whole_tape_equal_a_replay(spark):
    rng = random.Random(11)
    updates, clears, want = [], [], set()
    for instrument, last in ((1, 1350), (2, 720)):
        book = {}
        for seq in range(1, last + 1):
            if seq % 90 == 17:
                side, scope, at = rng.randrange(3), rng.randrange(2), rng.randrange(12)
                scope = 0 if side == 2 else scope
                clears.append((instrument, seq, side, scope, at))
                book = {(s, p): q for (s, p), q in book.items() if not (side in (2, s) and (scope == 0 or (p <= at if s == 0 else p >= at)))}
            else:
                side, price, qty = rng.randrange(2), rng.randrange(12), rng.choice([0, 1, 5, 9])
                updates.append((instrument, seq, side, price, qty))
                book[side, price] = qty
            if seq % 100 == 0 or seq == last:
                want |= {(instrument, seq, s, p, q) for (s, p), q in book.items() if q}
    u = spark.createDataFrame(updates, "instrument int, per_seq bigint, side int, price bigint, qty bigint")
    c = spark.createDataFrame(clears, "instrument int, per_seq bigint, clear_side int, scope int, from_price bigint")
    points = spark.createDataFrame([(i, k) for i, last in ((1, 1350), (2, 720)) for k in {*range(100, last, 100), last}], "instrument int, k bigint")
    got = levels.ladder_asof(u, points, ["instrument"], c).collect()
    assert len(got) == len(want) and {(r["instrument"], r["k"], r["side"], r["price"], r["qty"]) for r in got} == want


@pytest.mark.parametrize("window", [0, 1, 3, 8])
def test_emission_equals_a_buffer(spark, window):
    rng = random.Random(window)
    seqs = [k for k in range(200) if k % 17]
    for _ in range(60):  # most within the window, some far off
        i = rng.randrange(len(seqs))
        seqs.insert(min(len(seqs), i + rng.choice([1, 2, 3, 12, 40])), seqs.pop(i))
    df = spark.createDataFrame([("c", s, a) for a, s in enumerate(seqs)], "c string, seq bigint, arrival bigint")
    got = {r["seq"]: r["emit_pos"] for r in o.with_emit_position(df, ["c"], window=window).collect()}
    heap, left = [], {}
    for a, s in enumerate(seqs):
        heapq.heappush(heap, s)
        if len(heap) > window:
            left[heapq.heappop(heap)] = a
    assert got == left | {s: 1 << 60 for s in heap}


def test_slices_of_one_channel(spark):
    """One channel's rows are spread over tasks by slices of their order, and come to what a window over the channel says."""
    rows = [("t", 0, "m", i, i * 7 % 400 // 2, i // 90 % 3, 1000 - i % 13) for i in range(400)]
    df = spark.createDataFrame(rows, "capture_id string, channel_id int, port string, arrival bigint, seq bigint, reset_count int, send_ts bigint")
    df = df.withColumn("pos", F.struct(F.col("arrival").alias("emit_pos"), "seq"))
    by_arrival, by_seq = o.slices(df, ["channel_id", "port"], "arrival", "seq", size=25)
    assert len(by_arrival.bounds) == 15 and by_arrival.tasks == 8
    assert o.slices(df, ["channel_id", "port"], "arrival", size=400) == [None]
    keys = ["capture_id", "channel_id"]
    most = by_arrival.spread(df, keys, F.col("arrival")).groupBy(F.spark_partition_id(), "__slice").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= 40 and most[1] == 16
    dims = df.where("arrival % 60 = 31").select(*keys, "pos", F.col("arrival").alias("was"))
    made = {
        "numbered": lambda a, s: o.numbered(df, keys, ["arrival"], "n", a), "gaps": lambda a, s: o.with_gaps(df, keys, "seq", ["pos"], a),
        "previous": lambda a, s: o.with_previous(df, keys, ["pos"], a, before="send_ts"), "late": lambda a, s: o.with_late(df, keys, window=3, cuts=a),
        "emitted": lambda a, s: o.with_emit_position(df, keys, window=3, cuts=(a, s)), "eras": lambda a, s: o.with_common_eras(df, keys, "port", cuts=a),
        "asof": lambda a, s: o.asof(df, dims, keys, "pos", ["was"], strict=True, cuts=a), "next": lambda a, s: o.asof(df, dims, keys, "pos", ["was"], forward=True, cuts=a),
    }
    for name, make in made.items():
        plain, cut = make(None, None), make(by_arrival, by_seq)
        assert sorted(map(str, plain.collect())) == sorted(map(str, cut.select(*plain.columns).collect())), name


def test_a_channel_of_many_short_eras_is_cut_into_slices(spark, monkeypatch):
    """No era has many frames, but the channel has: what goes over all its eras is spread, and says the same."""
    from tickloom import engine
    from tickloom.plans.wire import feed_check_top_of_book

    folder, runs = "/root/testdata/sf0.001", []
    monkeypatch.setattr(engine.Run, "_sequence", lambda self, *a, own=engine.Run._sequence: (runs.append(self), own(self, *a))[1])
    plain = feed_check_top_of_book(spark, folder).collect()
    monkeypatch.setattr(engine, "CHANNEL_ROWS", 20)
    monkeypatch.setattr(o, "SLICE_ROWS", 15)
    assert sorted(map(str, feed_check_top_of_book(spark, folder).collect())) == sorted(map(str, plain))
    assert runs[0].channel_cuts is None and runs[1].cuts is None and len(runs[1].channel_cuts.bounds) > 3


def test_frames_without_a_buffer_are_not_shuffled(spark, capsys):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([3, 1, 2, 5, 4, 9, 7, 8])], "c int, arrival bigint, seq bigint")
    out = o.with_emit_position(df, ["c"], window=0)
    assert rows(out, "arrival", "emit_pos") == [(i, i) for i in range(8)]
    capsys.readouterr()
    out.explain()
    assert "Exchange" not in capsys.readouterr().out


@pytest.mark.parametrize("seed", range(3))
def test_asof_joins_of_few_rows_equal_the_others(spark, seed):
    r = random.Random(seed)
    some = lambda n: [(r.choice([None, 1, 2]), p, r.randrange(100)) for p in r.sample(range(-50, 50), n)]
    facts = spark.createDataFrame([*some(40), (1, None, 7)], "c int, pos bigint, f int")
    dims = spark.createDataFrame([(c, p, v) for c, p, v in some(25)], "c int, pos int, v int")
    whole = lambda df: sorted(map(str, df.select("c", "pos", "f", "v").collect()))
    for strict in (False, True):
        for forward in (False, True):
            known = facts.where("pos is not null") if forward else facts
            assert whole(o.asof_few(known, dims, ["c"], "pos", ["v"], strict, forward)) == whole(o.asof(known, dims, ["c"], "pos", ["v"], strict, forward))
    assert whole(o.asof_of_few(facts, dims, ["c"], "pos", ["v"])) == whole(o.asof(facts, dims, ["c"], "pos", ["v"]))
    none = dims.where("false")
    assert whole(o.asof_few(facts, none, ["c"], "pos", ["v"])) == whole(o.asof(facts, none, ["c"], "pos", ["v"]))


def test_eras_of_reset_counts_that_come_in_runs(spark):
    one = [(0, "a", 1, 250), (0, "b", 2, 249), (0, "a", 3, 251), (0, "a", 4, 251), (0, "b", 5, 251), (0, "a", 6, 3), (0, "b", 7, 130), (0, "b", 8, 130), (1, "a", 9, 0)]
    df = spark.createDataFrame(one, "c int, port string, arrival bigint, reset_count bigint")
    columns = ("c", "port", "arrival", "era_no", "era_state")
    assert rows(o.with_eras_of_counts(df, ["c"], "port"), *columns) == rows(o.with_common_eras(df, ["c"], "port"), *columns)
    again = df.unionByName(spark.createDataFrame([(0, "a", 10, 251)], df.schema))
    assert o.with_eras_of_counts(again, ["c"], "port") is None


def test_few_groups_equal_the_others(spark):
    r, made, pos = random.Random(5), [], 0
    for g in range(12):
        for kind in [*r.choices(["begin"], k=g > 0), *r.choices(["row"], k=r.randrange(6)), *r.choices(["end"], k=r.randrange(3)), *r.choices(["row"], k=r.randrange(2))]:
            made.append((1, pos, kind, g + (r.random() < 0.2), r.choice([7, 8]) if kind != "row" else None, 0, 3 if kind == "begin" else None, r.choice(["x", "y", "z", None]) if kind == "row" else None, pos, 0, False, None))
            pos += 1
    df = spark.createDataFrame(made, "c int, pos bigint, kind string, snapshot_id int, instrument int, anchor bigint, total int, key string, seq bigint, lost_frames bigint, dirty boolean, last_seq bigint")
    df = o.with_islands(df, ["c"], F.col("kind") == "begin", ["pos"])
    whole = snapshots.groups(df, ["c"])
    assert rows(snapshots.few_groups(df, ["c"]).fillna(-1), *whole.columns) == rows(whole.fillna(-1), *whole.columns)
