import json
import struct

import pytest
from pyspark.sql import functions as F

from tickloom.operators.findings import graded
from tickloom.sources.captures import port_map, read_pcap, read_spool
from tickloom.sources.reports import in_registry, metrics, read_ranges, write_report
from tickloom.streaming.replay import count_stream, dedupe_intents, replay_stream


def udp_packet(port, payload):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28 + len(payload), 0, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return b"\0" * 12 + b"\x08\x00" + ip + struct.pack(">HHHH", 50000, port, 8 + len(payload), 0) + payload


@pytest.mark.parametrize(("order", "magic", "unit"), [("<", b"\xd4\xc3\xb2\xa1", 1000), (">", b"\xa1\xb2\x3c\x4d", 1)])
def test_pcap(spark, tmp_path, order, magic, unit):
    packets = [udp_packet(18001, b"one"), udp_packet(9, b"other"), b"\0" * 40, udp_packet(18002, b"two")]
    with open(tmp_path / "a.pcap", "wb") as f:
        f.write(magic + b"\0" * 20)
        for k, p in enumerate(packets):
            f.write(struct.pack(order + "IIII", 5, k, len(p), len(p)) + p)
    got = read_pcap(spark, str(tmp_path), "18001=mktdata,18002=refdata,0=snapshot").orderBy("arrival").collect()
    assert [(r["port"], bytes(r["raw"]), r["recv_ns"]) for r in got] == [("mktdata", b"one", 5 * 10**9), ("refdata", b"two", 5 * 10**9 + 3 * unit)]


def test_no_port_is_an_error():
    with pytest.raises(ValueError):
        port_map("0=mktdata")


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"spec_revision": "x", "ranges": [{"lo": 1, "hi": 5}, {"lo": 9, "hi": 9}]}))
    ranges = read_ranges(spark, str(tmp_path / "r.json"))
    got = in_registry(spark.createDataFrame([(x,) for x in (0, 1, 5, 6, 9)], "source int"), ranges)
    assert {r["source"]: r["in_registry"] for r in got.collect()} == {0: False, 1: True, 5: True, 6: False, 9: True}


def test_report_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("mbo", "FIELD.SIDE_ENUM", "violation", None), ("mbo", "FIELD.SIDE_ENUM", "unverifiable", "loss")], "feed string, rule_id string, status string, reason string")
    write_report(df, str(tmp_path / "out"), "mbo")
    got = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert got["rules"] == [{"rule_id": "FIELD.SIDE_ENUM", "counts": {"violation": 1, "unverifiable": 1}, "unverifiable_by_reason": {"loss": 1}}]
    lines = {r[0] for r in metrics(graded(df)).collect()}
    assert 'feed_unverifiable_total{feed="mbo",rule_id="FIELD.SIDE_ENUM",reason="loss"} 1' in lines and len(lines) == 3


def test_streaming_replay_equals_batch(spark, tmp_path):
    from tests.test_operators import random_tape
    from tickloom.streaming.replay import replay_batch

    schema = "capture_id string, channel_id bigint, port string, arrival bigint, seq bigint, reset_count bigint, send_ts bigint, payload bigint"
    tape = [("c", 1, "mktdata", *t) for t in random_tape(4, 200)]
    for k in range(0, len(tape), 60):
        spark.createDataFrame(tape[k : k + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay_stream(stream, window=0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = ["era_no", "seq", "rule_id"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(key).collect()))
    want = sorted(map(tuple, replay_batch(spark.createDataFrame(tape, schema), window=0).select(key).collect()))
    assert got == want and got


def test_streaming_dedupe_counts_and_spool(spark, tmp_path):
    df = spark.range(20).select(F.timestamp_seconds(F.col("id")).alias("event_time"), (F.col("id") % 5).alias("source"), F.lit(1).alias("action_tag"), F.lit(0).alias("batch_index"), F.lit("s").alias("signer"), F.lit("r").alias("rule_id"), F.lit("pass").alias("status"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = dedupe_intents(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 5
    q = count_stream(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").first()["count"] == 20
    assert read_spool(spark, str(tmp_path)).isStreaming
