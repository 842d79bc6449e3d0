import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.functions import wire as w
from tickloom.functions.layout import MAGIC, MESSAGES, SCHEMA_VERSION, message
from tickloom.functions.rules import REASONS, RULES, SEVERITIES, catalogue, starved
from tickloom.operators.frames import decode_frames, frame_findings, messages_of, starts_of, structural


def raw_frame(feed, *messages, count=None, length=None, seq=1, channel=3, version=None, reset=0):
    body = b"".join(messages)
    return struct.pack("<HBBQQBBH", MAGIC[feed], SCHEMA_VERSION[feed] if version is None else version, channel, seq, 1000, len(messages) if count is None else count, reset, 24 + len(body) if length is None else length) + body


def raw_message(kind, size, body=b"", flags=0):
    return struct.pack("<BBH", kind, size, flags) + body.ljust(size - 4, b"\0")


def test_layouts_fit_their_lengths():
    for m in MESSAGES.values():
        ends = [f.offset + f.size for f in m.fields]
        assert max(ends) <= m.length
        assert all(a <= b.offset for a, b in zip(ends, m.fields[1:], strict=False))


def test_catalogue_counts():
    rows = catalogue()
    assert len(rows) == len(RULES) == 88
    assert {s: sum(r["severity"] == s for r in rows) for s in SEVERITIES} == {"must": 49, "should": 26, "info": 13}
    assert sum(r["tier"] == 1 for r in rows) == 27
    assert (sum(r["conditional"] for r in rows), sum(r["owes"] for r in rows), sum(r["snapshot_driven"] for r in rows)) == (5, 18, 16)
    assert len(REASONS) == 12
    assert starved("mbp", {"mktdata"}) == ["MBP.SNAP.GROUP_STRUCTURE", "MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT"]
    assert starved("mbo", {"mktdata", "snapshot"}) == []


BEAT = raw_message(1, 16, b"\x03")
CASES = {
    "good": (raw_frame("mbo", BEAT, BEAT), []),
    "runt": (b"\x44\x44\x03", [("FRAME.LENGTH_CONSISTENCY", True)]),
    "magic": (raw_frame("tob", BEAT), [("FRAME.MAGIC_MISMATCH", False)]),
    "version": (raw_frame("mbo", BEAT, version=2), [("FRAME.SCHEMA_VERSION", False)]),
    "count zero": (raw_frame("mbo", BEAT, count=0), [("FRAME.MSG_COUNT_RANGE", False)]),
    "count": (raw_frame("mbo", BEAT, count=2), [("FRAME.MSG_COUNT_RANGE", False)]),
    "cut": (raw_frame("mbo", BEAT, BEAT)[:-3], [("FRAME.LENGTH_CONSISTENCY", True), ("FRAME.LENGTH_CONSISTENCY", True)]),
    "trailing": (raw_frame("mbo", BEAT) + b"xy", [("FRAME.LENGTH_CONSISTENCY", False)]),
    "length out of range": (raw_frame("mbo", BEAT, length=5000), [("FRAME.LENGTH_CONSISTENCY", False), ("FRAME.MSG_COUNT_RANGE", False)][:1]),
    "short message": (raw_frame("mbo", b"\x01\x02\0\0", count=0), [("MSG.LENGTH_PER_TYPE", False), ("FRAME.MSG_COUNT_RANGE", False), ("FRAME.LENGTH_CONSISTENCY", False)]),
    "rest": (raw_frame("mbo", BEAT, b"\x01\x10", count=1), [("FRAME.LENGTH_CONSISTENCY", False), ("FRAME.LENGTH_CONSISTENCY", False)]),
}


def test_frame_rules(spark):
    names = list(CASES)
    grams = spark.createDataFrame([("c", k, "mktdata", bytearray(CASES[n][0])) for k, n in enumerate(names)] + [("c", 99, "mktdata", None)], "capture_id string, arrival bigint, port string, raw binary")
    got = {r["arrival"]: [(f["rule_id"], f["transport"]) for f in r["findings"]] for r in decode_frames(grams, "mbo").collect()}
    assert {n: got[k] for k, n in enumerate(names)} == {n: want for n, (_, want) in CASES.items()}
    assert got[99] == [("FRAME.LENGTH_CONSISTENCY", True)]


def test_starts_equal_a_plain_loop():
    rng = random.Random(1)
    rows = [None, b"", b"x" * 23]
    for _ in range(300):
        raw = bytearray(rng.randrange(256) for _ in range(rng.randrange(24, 200)))
        for at in range(25, len(raw)):
            raw[at] = rng.choice([0, 3, 4, 5, 8, 16, 40])
        raw[22:24] = rng.choice([len(raw), len(raw) - 3, len(raw) + 9, 30000]).to_bytes(2, "little")
        rows.append(bytes(raw))
    got = starts_of(pa.concat_arrays([pa.array(rows[:2], pa.binary()), pa.array([b"left out", *rows[2:]], pa.binary())[1:]])).to_pylist()
    for raw, found in zip(rows, got, strict=True):
        want, at = [], 24
        end = min(len(raw), int.from_bytes(raw[22:24], "little")) if raw and len(raw) >= 24 else 0
        while at + 4 <= end and 4 <= raw[at + 1] <= end - at:
            want.append(at)
            at += raw[at + 1]
        assert found == want


def test_short_bodies_read_as_zero(spark):
    fields = message("mbo", "definition").fields
    df = spark.createDataFrame([(bytearray(b"\x05\0\0\0"),)], "body binary")
    got = df.select(*(w.read(F.col("body"), f).alias(f.name) for f in fields if f.kind[0] not in "cb")).first()
    assert got["instrument"] == 5 and all(int(v) == 0 for k, v in got.asDict().items() if k != "instrument")


def test_encode_then_decode(spark):
    m = message("mbo", "order_execute")
    values = {"instrument": 4294967295, "source": 65535, "aggressor": 2, "exec_flags": 1, "per_seq": 7, "order_id": 2**63 + 5, "trade_id": 9, "ts": 11, "price": -123456789, "qty": 2**64 - 1}
    columns = {k: F.lit(str(v)).cast("decimal(20,0)") for k, v in values.items()}
    raw = w.frame("mbo", F.lit(3), F.lit(12), F.lit(5), F.lit(0), w.write(m, columns), F.lit(1))
    grams = spark.range(1).select(F.lit("c").alias("capture_id"), F.col("id").alias("arrival"), F.lit("mktdata").alias("port"), raw.alias("raw"))
    frames = decode_frames(grams, "mbo")
    got = w.decode(messages_of(frames), m, ("seq", "channel_id")).first()
    assert {k: int(got[k]) for k in values} == values and (got["seq"], got["channel_id"]) == (12, 3)
    assert frame_findings(frames).count() == 0


def test_numbers_are_turned_at_once(spark):
    """A number is read by one substring, not one for each byte, and equals what struct packs at every size and bound."""
    field = next(f for f in message("mbo", "order_execute").fields if f.kind == "u64")
    assert w.reading("body", field).count("substring(") == 1
    for size, values in ((1, (0, 200, 255)), (2, (0, 258, 65535)), (4, (1, 128 << 24, 2**32 - 1)), (8, (0, 0x0102030405060708, 2**63, 2**64 - 1))):
        got = spark.range(1).select(*(w.little(F.lit(str(v)).cast("decimal(20,0)"), size) for v in values)).first()
        assert [bytes(b) for b in got] == [v.to_bytes(size, "little") for v in values]
    got = spark.range(1).select(w.little(F.lit(-2), 1), w.little(F.lit(-2), 8)).first()
    assert [bytes(b) for b in got] == [b"\xfe", b"\xfe" + b"\xff" * 7]


def test_fields_of_a_message_share_one_reversal(spark):
    """Fields read from a body held backward equal those read alone, also where the body is too short, without a reversal."""
    m = message("mbo", "order_execute")
    numbers = [f for f in m.fields if f.kind[0] not in "cb"]
    assert not any("reverse(" in w.reading("body", f, back="back") for f in numbers)
    bodies = [bytes(range(200, 252)), b"\xff" * 52, bytes(range(11)), b""]
    df = spark.createDataFrame([(bytearray(b),) for b in bodies], "body binary").selectExpr("body", f"{w.backward('body')} as back")
    for alone, shared in df.select(F.struct(*(w.read("body", f).alias(f.name) for f in numbers)), F.struct(*(w.read("body", f, back="back").alias(f.name) for f in numbers))).collect():
        assert alone == shared


#: feed, port, message, the structural findings it gives.
VECTORS = [
    ("mbo", "mktdata", raw_message(3, 8), ["MSG.RESERVED_TYPE_0X03_0X05"]),
    ("mbo", "mktdata", raw_message(99, 8), ["MSG.UNKNOWN_TYPE_SKIPPED"]),
    ("mbo", "mktdata", raw_message(8, 48), ["MSG.UNKNOWN_TYPE_SKIPPED"]),
    ("mbo", "mktdata", raw_message(1, 20), ["MSG.LENGTH_PER_TYPE"]),
    ("mbo", "refdata", BEAT, ["MSG.WRONG_PORT_PLACEMENT"]),
    ("mbo", "mktdata", raw_message(1, 16, b"\x04"), ["HEARTBEAT.CHANNEL_ID_MATCH"]),
    ("mbo", "mktdata", raw_message(16, 52, b"\0" * 6 + b"\x02\x20" + b"\0" * 28), ["FIELD.SIDE_ENUM", "FIELD.QTY_POSITIVE", "RESERVED.FIELD_BITS_ZERO"]),
    ("mbo", "mktdata", raw_message(18, 56, b"\0" * 6 + b"\x03\x04"), ["FIELD.AGGRESSOR_SIDE_ENUM", "RESERVED.FIELD_BITS_ZERO"]),
    ("mbo", "mktdata", raw_message(4, 52, b"\0" * 6 + b"\x03"), ["FIELD.AGGRESSOR_SIDE_ENUM"]),
    ("mbo", "mktdata", raw_message(20, 28), ["RESET.ANCHOR_SEQ_IS_CURRENT_FRAME"]),
    ("mbo", "snapshot", raw_message(33, 44, b"\0" * 12 + b"\x02\x40"), ["SNAP.ORDER_STRUCT_VALID"] * 3),
    ("mbp", "snapshot", raw_message(66, 32, flags=0), ["MSG.SNAPSHOT_FLAG_MATCHES_PORT"]),
    ("mbp", "snapshot", raw_message(66, 32, flags=1), []),
    ("tob", "mktdata", raw_message(3, 56), ["MSG.LENGTH_PER_TYPE", "TOB.QUOTE.STRUCT_LEN_TYPE"]),
    ("tob", "mktdata", raw_message(3, 60), ["TOB.QUOTE.CROSSED_LOCKED", "TOB.QUOTE.UPDATE_FLAGS_COHERENCE", "TOB.QUOTE.SOURCE_ID_REGISTRY"]),
    ("tob", "mktdata", raw_message(3, 60, b"\0" * 4 + b"\x01\0\x0c" + b"\0" * 9 + b"\x01"), ["TOB.QUOTE.GONE_VS_ZERO_PRICE"]),
    ("tob", "mktdata", raw_message(4, 52, b"\0" * 4 + b"\xff\xff\x03\x08"), ["TOB.TRADE.FIELDS"] * 3),
    ("midpoint", "mktdata", raw_message(3, 36), ["MSG.LENGTH_PER_TYPE", "MID.STRUCT_LEN_TYPE"]),
    ("midpoint", "mktdata", raw_message(3, 40, b"\0" * 6 + b"\x05\x10" + b"\x02" + b"\0" * 7 + b"\x01"), ["MID.METHOD_RANGE", "MID.QUALITY_FLAGS", "MID.TIMESTAMP_ORDERING"]),
]


@pytest.mark.parametrize("feed", ["mbo", "mbp", "tob", "midpoint"])
def test_structural_vectors(spark, feed):
    own = [(i, port, bytearray(raw_frame(feed, m))) for i, (f, port, m, _) in enumerate(VECTORS) if f == feed]
    grams = spark.createDataFrame([("c", i, p, r) for i, p, r in own], "capture_id string, arrival bigint, port string, raw binary")
    got = {}
    for r in structural(messages_of(decode_frames(grams, feed)), feed).collect():
        got.setdefault(r["arrival"], []).append(r["rule_id"])
    assert {i: sorted(got.get(i, [])) for i, *_ in own} == {i: sorted(VECTORS[i][3]) for i, *_ in own}


def test_every_structural_rule_has_a_vector():
    fired = {r for *_, rules in VECTORS for r in rules} | {r for _, want in CASES.values() for r, _ in want}
    done = {"MSG.SNAPSHOT_FLAG_MATCHES_PORT", "TOB.QUOTE.SOURCE_COUNT"}  # source counts are covered by their query
    assert {r for r, x in RULES.items() if x["tier"] == 1} <= fired | done
