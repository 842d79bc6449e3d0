"""The live source under failures: budgets, segments, offsets and restarts."""

import socket
import threading

import pyarrow as pa
import pytest

from tickloom.sources.live import Budget, SourceFailed, bind, numbers, read_live, receive, store_of


def failing(times, then=b"x"):
    left = [times]

    def read():
        if left[0]:
            left[0] -= 1
            raise OSError("the interface is down")
        return then, ("10.0.0.1", 5)

    return read


def test_failures_in_a_row_use_up_the_budget():
    assert Budget("p", 256, 0).call(failing(255)) == (b"x", ("10.0.0.1", 5))
    with pytest.raises(SourceFailed, match="p: read failed 256 times in a row: the interface is down"):
        Budget("p", 256, 0).call(failing(256))
    b = Budget("p", 3, 0)  # a success in between gives the budget back
    assert all(b.call(failing(2)) for _ in range(5))
    waits = Budget("p", 2, 0)
    assert waits.call(lambda: (_ for _ in ()).throw(TimeoutError())) is None and waits.failures == 0


def test_what_was_read_before_the_end_is_kept(tmp_path):
    good = iter([b"a", b"b"])

    def read():
        if (x := next(good, None)) is None:
            raise OSError("gone")
        return x, ("10.0.0.1", 5)

    with pytest.raises(SourceFailed):
        receive(read, str(tmp_path), "mktdata", 1, lambda: False, budget=Budget("mktdata port", 4, 0))
    store, at = store_of(str(tmp_path))
    (number,) = numbers(store, at)["mktdata"]
    with store.open_input_file(f"{at}/mktdata-{number}.arrow") as f:
        assert pa.ipc.open_file(f).read_all()["raw"].to_pylist() == [b"a", b"b"]


def stream(spark, source, out, **options):
    q = read_live(spark, source, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-at").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_datagrams_of_a_socket_come_once_across_restarts(spark, tmp_path):
    source, out = str(tmp_path / "segments"), str(tmp_path / "out")
    with bind("127.0.0.1", 0) as s, socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as sender:
        number = s.getsockname()[1]
        done = threading.Event()
        got = []
        t = threading.Thread(target=lambda: got.append(receive(lambda: s.recvfrom(65_535), source, "mktdata", number, done.is_set, rows=3)))
        t.start()
        for k in range(10):
            sender.sendto(b"%d" % k, ("127.0.0.1", number))
        while sum(len(n) for n in numbers(*store_of(source)).values()) < 3:
            pass
        stream(spark, source, out)
        for k in range(10, 17):
            sender.sendto(b"%d" % k, ("127.0.0.1", number))
        done.wait(0.5)
        done.set()
        t.join()
    receive(failing(5, b"r"), source, "refdata", 2, iter([False, True]).__next__)
    stream(spark, source, out)
    rows = spark.read.parquet(out).orderBy("arrival").collect()
    assert got == [17] and [bytes(r["raw"]) for r in rows if r["port"] == "mktdata"] == [b"%d" % k for k in range(17)]
    assert [bytes(r["raw"]) for r in rows if r["port"] == "refdata"] == [b"r"]


def test_a_segment_that_can_not_be_read_fails_the_query(spark, tmp_path):
    source = tmp_path / "segments"
    source.mkdir()
    (source / "mktdata-7.arrow").write_bytes(b"no arrow file")
    with pytest.raises(Exception, match="mktdata port, segment 7: read failed 3 times in a row"):
        stream(spark, str(source), str(tmp_path / "out"), failures="3", backoff="0")
