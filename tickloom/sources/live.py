"""A live source: receivers keep datagrams as numbered segments in a shared folder, and the streaming format "live" reads
these with offsets.

A socket can't be asked again for what it gave, so a receiver writes before anything is read: an Arrow file for each
``rows`` datagrams or ``seconds``, renamed into place when it is whole. ``run_receivers`` keeps one long task per port
going on the cluster. The stream's offset is the last segment of each port; a restart, or a task that is lost, reads the
same segments again, and a commit deletes them.

Reads fail now and then (an interface that goes down, a store that is away). Each failure is waited out for ``backoff``
seconds, and ``limit`` failures in a row are a terminal error: a feed that has stopped must not look like a quiet one.
"""

from __future__ import annotations

import socket
import struct
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .captures import SCHEMA, port_map

_COLUMNS = pa.schema([("capture_id", pa.string()), ("arrival", pa.int64()), ("port", pa.string()), ("src_ip", pa.string()), ("dst_port", pa.int32()), ("recv_ns", pa.int64()), ("raw", pa.binary())])


class SourceFailed(RuntimeError):
    """A read failed as often in a row as its budget allows."""


@dataclass
class Budget:
    """Consecutive failures that are waited out."""

    what: str
    limit: int = 256
    backoff: float = 0.005
    failures: int = 0

    def call(self, read: Callable[[], object]) -> object:
        """What ``read`` gives, at the latest on the last attempt of the budget. Running out of time is no failure."""
        while True:
            try:
                got = read()
            except TimeoutError:
                return None
            except Exception as e:
                self.failures += 1
                if self.failures >= self.limit:
                    raise SourceFailed(f"{self.what}: read failed {self.failures} times in a row: {e}") from e
                time.sleep(self.backoff)
            else:
                self.failures = 0
                return got


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def bind(group: str, number: int, interface: str = "0.0.0.0", wait: float = 0.05) -> socket.socket:
    """A UDP socket on a port, joined to the group if that is a multicast address."""
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
    s.bind((group, number))
    if 224 <= int(group.split(".")[0]) <= 239:
        s.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, struct.pack("4s4s", socket.inet_aton(group), socket.inet_aton(interface)))
    s.settimeout(wait)
    return s


def numbers(store: fs.FileSystem, folder: str) -> dict[str, list[int]]:
    """The whole segments of each port, by number."""
    out: dict[str, list[int]] = {}
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        port, dash, n = f.base_name.removesuffix(".arrow").rpartition("-")
        if dash and f.base_name.endswith(".arrow"):
            out.setdefault(port, []).append(int(n))
    return {port: sorted(n) for port, n in out.items()}


def receive(read: Callable[[], tuple[bytes, tuple]], folder: str, port: str, number: int, stop: Callable[[], bool], rows: int = 4096, seconds: float = 0.2, budget: Budget | None = None) -> int:
    """Keeps what ``read`` gives (payload, address) until ``stop``; returns the datagrams. A segment that is begun is
    written before the budget's error is raised."""
    store, at = store_of(folder)
    store.create_dir(at, recursive=True)
    budget = budget or Budget(f"{port} port")
    segment = max(numbers(store, at).get(port, [time.time_ns()])) + 1
    held: list[tuple] = []
    count, since = 0, time.monotonic()

    def keep() -> None:
        nonlocal segment, held
        if held:
            with store.open_output_stream(f"{at}/{port}-{segment}.part") as out, pa.ipc.new_file(out, _COLUMNS) as file:
                file.write_batch(pa.RecordBatch.from_pylist([dict(zip(_COLUMNS.names, r, strict=True)) for r in held], schema=_COLUMNS))
            store.move(f"{at}/{port}-{segment}.part", f"{at}/{port}-{segment}.arrow")
            segment, held = segment + 1, []

    try:
        while not stop():
            got = budget.call(read)
            if got is not None:
                now = time.time_ns()
                held.append((folder, now, port, got[1][0], number, now, got[0]))
                count += 1
            if len(held) >= rows or (held and time.monotonic() - since >= seconds):
                keep()
                since = time.monotonic()
    finally:
        keep()
    return count


def run_receivers(spark: SparkSession, folder: str, ports: str, group: str, seconds: float, interface: str = "0.0.0.0") -> int:
    """A receiver for each port (such as "18001=mktdata,18002=refdata") as a task of its own, for ``seconds``; the datagrams
    kept. A port that fails for good fails the job."""
    roles = sorted(port_map(ports).items())

    def one(number: int, role: str) -> int:
        s, end = bind(group, number, interface), time.monotonic() + seconds
        with s:
            return receive(lambda: s.recvfrom(65_535), folder, role, number, lambda: time.monotonic() > end)

    # A socket is held by a task as long as it lives: the one place where a partition's work is imperative.
    return spark.sparkContext.parallelize(roles, len(roles)).map(lambda x: one(*x)).sum()


@dataclass
class _Segment(InputPartition):
    port: str
    number: int


class _Segments(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.keeps = options["path"], options.get("keep", "false") == "true"
        self.limit, self.backoff = int(options.get("failures", "256")), float(options.get("backoff", "0.005"))

    def _budget(self, what: str) -> Budget:
        return Budget(what, self.limit, self.backoff)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, at = store_of(self.path)
        return {port: n[-1] for port, n in self._budget("segments").call(lambda: numbers(store, at)).items()}

    def _between(self, start: dict, end: dict) -> list[_Segment]:
        store, at = store_of(self.path)
        there = self._budget("segments").call(lambda: numbers(store, at))
        return [_Segment(port, n) for port, last in sorted(end.items()) for n in there.get(port, []) if start.get(port, -1) < n <= last]

    def partitions(self, start: dict, end: dict) -> list[_Segment]:
        return self._between(start, end)

    def read(self, partition: _Segment) -> Iterator[pa.RecordBatch]:
        store, at = store_of(self.path)

        def whole() -> pa.Table:
            with store.open_input_file(f"{at}/{partition.port}-{partition.number}.arrow") as f:
                return pa.ipc.open_file(f).read_all()

        yield from self._budget(f"{partition.port} port, segment {partition.number}").call(whole).to_batches()

    def commit(self, end: dict) -> None:
        if not self.keeps:
            store, at = store_of(self.path)
            for s in self._between({}, end):
                store.delete_file(f"{at}/{s.port}-{s.number}.arrow")


class LiveSource(DataSource):
    """Options: path (of the segments), keep ("true": committed segments stay), failures and backoff of the budget."""

    @classmethod
    def name(cls) -> str:
        return "live"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Segments(dict(self.options))


def read_live(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Stream of the datagrams that receivers keep in a folder."""
    spark.dataSource.register(LiveSource)
    return spark.readStream.format("live").options(path=path, **options).load()
