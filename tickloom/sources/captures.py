"""Captures and spools of datagrams.

``register(spark)`` adds the batch format "pcap": classic capture files, read as streams by one task per file, so that a
file of any size needs little memory. Options: path (a file or folder of any store that pyarrow opens), ports (such as
"18001=mktdata,18002=refdata"); packets to other ports are dropped in the reader.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "capture_id string, arrival bigint, port string, src_ip string, dst_port int, recv_ns bigint, raw binary"


def port_map(text: str) -> dict[int, str]:
    """Ports by number; port 0 is not scanned, and no port at all is an error."""
    out = {int(n): role for n, _, role in (x.strip().partition("=") for x in text.split(",") if x.strip()) if int(n)}
    if not out:
        raise ValueError("no port is bound")
    return out


def packets(stream) -> Iterator[tuple[int, bytes]]:
    """(receive time in ns, packet) of a classic capture, of either byte order and resolution."""
    head = stream.read(24)
    if len(head) < 24:
        raise ValueError("the capture has no header")
    magics = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
    if head[:4] not in magics:
        raise ValueError("not a classic capture")
    order, unit = magics[head[:4]]
    while len(h := stream.read(16)) == 16:
        seconds, part, size, _ = struct.unpack(order + "IIII", h)
        data = stream.read(size)
        if len(data) < size:
            return
        yield seconds * 1_000_000_000 + part * unit, data


def udp(packet: bytes) -> tuple[str, int, bytes] | None:
    """(source address, destination port, payload) of an Ethernet, IPv4, UDP packet; null for any other."""
    at = 14
    kind = packet[12:14]
    if kind == b"\x81\x00":
        kind, at = packet[16:18], 18
    if kind != b"\x08\x00" or len(packet) < at + 28 or packet[at + 9] != 17:
        return None
    u = at + (packet[at] & 15) * 4
    size = int.from_bytes(packet[u + 4 : u + 6], "big")
    return ".".join(map(str, packet[at + 12 : at + 16])), int.from_bytes(packet[u + 2 : u + 4], "big"), packet[u + 8 : u + size]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.ports = options["path"], port_map(options.get("ports", ""))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        store, p = self._open()
        info = store.get_file_info(p)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(p))
        return [InputPartition(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.path.endswith((".pcap", ".cap"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = self._open()
        arrival = 0
        with store.open_input_stream(partition.value) as stream:
            for ns, packet in packets(stream):
                got = udp(packet)
                if got and got[1] in self.ports:
                    yield partition.value, arrival, self.ports[got[1]], got[0], got[1], ns, got[2]
                    arrival += 1


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def read_pcap(spark: SparkSession, path: str, ports: str) -> DataFrame:
    register(spark)
    return spark.read.format("pcap").option("path", path).option("ports", ports).load()


def read_spool(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Stream of the datagrams that a receiver writes as Parquet files into a folder. A bad file fails the query."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)
