"""WARC archives: writing them as one gzip stream, normalising that to one member per record, and reading by index.

An archive that was compressed as a whole can't be entered in the middle. The normaliser inflates such a file once, as
a stream, writes each record as a gzip member of its own, and a sidecar file of JSON lines with the offset and length
of each member; readers then fetch single records. The normaliser passes records on in pieces, so its memory doesn't
depend on the length of a file or a record; a reader, and the writer of a page's record, hold one record at a time.

Each archive is written by one task from its partition, under a name no other attempt uses, and is listed in a written
manifest; archives roll over at a size limit. A task that is run again writes files of its own, and those of the failed
attempt are in no manifest. Paths of any store that pyarrow's file systems open work, the executors' shared folder too.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

PIECE = 1 << 20
DATE = "1970-01-01T00:00:00Z"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record of a page; a revisit has the HTTP header only. Control characters of the URL are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever members it has, in pieces. A last member without its end is an error, which only
    its checksum and length tell where the records in it are whole; zeros after a member are padding."""
    z, data, begun = zlib.decompressobj(31), stream.read(PIECE), False
    while data:
        if not begun and not (data := data.lstrip(b"\0")):
            data = stream.read(PIECE)
            continue
        begun = True
        out = z.decompress(data, PIECE)
        if out:
            yield out
        if z.eof:
            data = z.unused_data or stream.read(PIECE)
            z, begun = zlib.decompressobj(31), False
        else:
            data = z.unconsumed_tail or stream.read(PIECE)
    if begun:
        raise ValueError("the gzip stream is cut short")


def normalise_file(source: str, target: str, level: int = 3) -> int:
    """Rewrites ``source`` as ``target`` with a member for each record, and ``target``.idx; returns the records."""
    (here, a), (there, b) = open_store(source), open_store(target)
    count = offset = 0
    with here.open_input_stream(a, compression=None) as src, there.open_output_stream(b, compression=None) as out, there.open_output_stream(b + ".idx", compression=None) as idx:
        pieces, buffer = inflate(src), b""
        while True:
            while (end := buffer.find(b"\r\n\r\n")) < 0 and (more := next(pieces, b"")):
                buffer += more
            if end < 0:
                if buffer.strip():
                    raise ValueError(f"{source}: the last record is cut short")
                break
            head, buffer = buffer[: end + 4], buffer[end + 4 :]
            fields = header_fields(head[:-4])
            left = int(fields["content-length"]) + 4
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            size = out_write(out, z.compress(head))
            while left:
                if not buffer and not (buffer := next(pieces, b"")):
                    raise ValueError(f"{source}: a record is cut short")
                part, buffer = buffer[:left], buffer[left:]
                left -= len(part)
                size += out_write(out, z.compress(part))
            size += out_write(out, z.flush())
            line = {"offset": offset, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id")}
            idx.write(json.dumps(line).encode() + b"\n")
            offset, count = offset + size, count + 1
    return count


def out_write(out, data: bytes) -> int:
    if data:
        out.write(data)
    return len(data)


def read_indexed(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a normalised archive, each fetched by its entry in the index."""
    store, p = open_store(path)
    with store.open_input_stream(p + ".idx", compression=None) as f:
        entries = [json.loads(x) for x in f.read().splitlines()]
    with store.open_input_file(p) as f:
        for e in entries:
            f.seek(e["offset"])
            data = zlib.decompress(f.read(e["length"]), 31)
            end = data.index(b"\r\n\r\n")
            fields = header_fields(data[:end])
            yield fields, data[end + 4 : end + 4 + int(fields["content-length"])]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


def plan_records(pages: DataFrame, scratch: Scratch, least: int = 100) -> DataFrame:
    """page_id, url, html (binary), digest, refers_to, revisit for each page.

    First the digests that several rows of ``least`` bytes or more share are written as a table, from counts combined
    before the shuffle; joining it moves the pages only if it is too large to broadcast, and then both sides are plain
    tables, of which AQE can split a hot digest.
    """
    page = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    page = page.withColumn("digest", F.sha2("html", 256))
    same = page.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    same = scratch.table(same.where("rows > 1 and first is not null").select(F.col("digest").alias("shared"), "first"), "shared")
    page = page.join(same, F.col("digest") == F.col("shared"), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return page.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_monolithic(records: DataFrame, folder: str, roll: int = 256 << 20, level: int = 1) -> DataFrame:
    """Writes the records as archives of one gzip stream each; returns (path, records). Rolls over at ``roll`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        out = z = None
        name, count, size = "", 0, 0

        def done() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, count, size = f"{uuid.uuid4().hex}.whole.warc.gz", 0, 0
                    out, z = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                size += out_write(out, z.compress(record(*row)))
                count += 1
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return records.mapInArrow(run, "path string, records bigint")


def normalise(archives: DataFrame) -> DataFrame:
    """Normalises each archive of (path, records) beside the original; returns (path, records) of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = f"{path.removesuffix('.whole.warc.gz')}-{uuid.uuid4().hex}.warc.gz"
                count = normalise_file(path, target)
                yield pa.RecordBatch.from_pydict({"path": [target], "records": pa.array([count], pa.int64())})

    return archives.select("path", "records").mapInArrow(run, "path string, records bigint")


def read_records(archives: DataFrame, rows: int = 512) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of normalised archives.

    The digest of a response is computed anew and must equal the one in its header; a revisit's are of its header.
    """

    def parse(fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
        if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{fields['warc-record-id']}: payload and header disagree")
        return _page(fields["warc-record-id"]), length, digest, kind, _page(fields["warc-refers-to"]) if kind == "revisit" else None

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = []
                for fields, block in read_indexed(path):
                    found.append(parse(fields, block))
                    if len(found) >= rows:
                        yield batch_of(found)
                        found = []
                if found:
                    yield batch_of(found)

    return archives.select("path").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_pages(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives in the scratch folder, normalises and returns (path, records).

    Null html is an empty payload. Among equal payloads of 100 bytes or more, rows with the smallest page_id are
    responses and the others revisit it; rows that repeat that id are all responses, and rows whose ids are all null
    are responses too. A null url leaves the target header out; other columns are not looked at.
    """
    whole = scratch.table(write_monolithic(plan_records(pages, scratch), scratch.path("whole")), "whole-manifest")
    scratch.tables |= {"whole", "manifest"}
    spread = max(1, min(whole.count(), 10_000))
    done = scratch.table(normalise(whole.repartition(spread, "path")), "manifest")
    return done


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "warc") as scratch:
        archives = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
        spread = max(1, min(archives.count(), 10_000))
        return scratch.table(read_records(archives.repartition(spread, "path")), "records", keep=True)


OP3_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha256(b) as h from p),
f as (select *, min(page_id) over (partition by h) as first from d)
select page_id, n::bigint as payload_bytes, h as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from f
"""
