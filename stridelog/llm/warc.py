"""WARC records in ZIP packages, written and range-read.

A package is a ZIP archive whose members are *stored*: ``archive/data.warc.gz`` (each record its own gzip
member) and ``indexes/index.cdxj`` (offset and length of each record). The reader parses the end record,
the ZIP64 end record where there is one, the central directory and the local headers, finds the two
members' places, reads the index, and then reads runs of records by byte range; nothing is extracted.

Files are reached through ``pyarrow.fs`` by their URI, so a package may lie in any store it knows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, text_or_empty

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def open_fs(uri: str):
    """(file system, path in it)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


# ---------------------------------------------------------------- ZIP


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def _zip64(extra: bytes, fields: list[int]) -> list[int]:
    """Replaces 32-bit fields that are all ones by the values of the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, k, out = extra[at + 4 : at + 4 + n], 0, []
            for v in fields:
                if v == 0xFFFFFFFF and k + 8 <= len(body):
                    v, k = struct.unpack_from("<Q", body, k)[0], k + 8
                out.append(v)
            return out
        at += 4 + n
    return fields


def central_directory(f) -> list[Member]:
    """Members of the ZIP archive in the seekable file ``f``. Raises ValueError if it isn't one."""
    f.seek(0, 2)
    length = f.tell()
    tail_at = max(0, length - 22 - 65535 - 20)
    f.seek(tail_at)
    tail = f.read(length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    count, size, offset = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
        if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator is missing")
        f.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record is missing")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    f.seek(offset)
    directory, members, at = f.read(size), [], 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        crc, packed, full, n, x, c = struct.unpack_from("<IIIHHH", directory, at + 16)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, header = _zip64(directory[at + 46 + n : at + 46 + n + x], [full, packed, header])
        members.append(Member(name, method, crc, packed, full, header))
        at += 46 + n + x + c
    return members


def stored_range(f, member: Member) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes in the archive."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: only stored members can be range-read")
    f.seek(member.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    n, x = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + x, member.size


# ---------------------------------------------------------------- records


def _clean(value: str) -> str:
    """Header values hold no line ends or other controls."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, number: str) -> bytes:
    """A response record, or a revisit of ``refers_to``, whose HTTP headers keep the full payload's length."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, number)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode().strip() for k, _, v in (line.partition(b":") for line in text.split(b"\r\n")[1:])}


def read_record(record: bytes) -> dict:
    """page_id, url, record_type, payload_bytes, payload_digest (hex), refers_to and payload (null in a revisit).

    Raises ValueError if a length or the digest doesn't hold.
    """
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    n = int(fields["content-length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    length = int(_headers(http)["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    response = fields["warc-type"] == "response"
    if response and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "payload_bytes": length,
        "payload_digest": digest, "refers_to": number("x-refers-to-page-id"), "payload": payload if response else None,
    }


class PackageWriter:
    """Rolls packages of about ``target`` packed bytes under ``root``; only the current one's records are held."""

    def __init__(self, root: str, stem: str, target: int):
        self.fs, self.root = open_fs(root)
        self.uri, self.stem, self.target, self.made = root, stem, target, 0
        self.data, self.index, self.held = io.BytesIO(), [], 0
        self.fs.create_dir(self.root, recursive=True)

    def add(self, record: bytes, page_id: int | None) -> tuple[str, int, int] | None:
        """The finished package (uri, records, bytes) if this record filled it."""
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        body = pack.compress(record) + pack.flush()
        self.index.append(json.dumps({"page": page_id, "offset": self.held, "length": len(body)}))
        self.data.write(body)
        self.held += len(body)
        return self.close() if self.held >= self.target else None

    def close(self) -> tuple[str, int, int] | None:
        if not self.index:
            return None
        name, done = f"{self.stem}-{self.made:05d}.wacz", (len(self.index), self.held)
        with self.fs.open_output_stream(f"{self.root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for member, content in ((DATA, self.data.getbuffer()), (INDEX, "\n".join(self.index).encode())):
                with z.open(zipfile.ZipInfo(member), "w", force_zip64=len(content) >= 1 << 31) as f:
                    f.write(content)
        self.data, self.index, self.held, self.made = io.BytesIO(), [], 0, self.made + 1
        return f"{self.uri}/{name}", *done


# ---------------------------------------------------------------- Spark


def with_refers_to(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html and refers_to: for a page whose payload has ``least`` bytes or more and equals that of a page
    with a larger id, the largest such id. Rows that repeat the largest id are all responses; a null id is below all others.

    Only digests are grouped, with counts summed before the shuffle; a payload that very many pages share is a skewed
    join key, which the adaptive join splits.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    p = p.withColumn("_digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha1(F.col("html").cast("binary")))))
    last = p.filter("_digest IS NOT NULL").groupBy(F.col("_digest").alias("_d")).agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    joined = p.join(last, F.col("_digest") == F.col("_d"), "left")
    return joined.select("page_id", "url", "html", F.when(F.col("_last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_last"))), F.col("_last")).alias("refers_to"))


def write_packages(pages: DataFrame, root: str, target: int = 32 << 20) -> DataFrame:
    """Writes page_id, url, html, refers_to as packages; returns the manifest (uri, records, bytes), stored.

    A task that is run again writes files of new names; the manifest lists those of the attempt that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        writer = PackageWriter(root, f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", target)
        done, nth = [], 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(n) for n in ("page_id", "url", "html", "refers_to")), strict=True):
                nth += 1
                one = page_id.as_py()
                made = writer.add(warc_record(one, url.as_py(), html.as_py().encode(), refers.as_py(), f"{writer.stem}/{nth}"), one)
                if made:
                    done.append(made)
        if made := writer.close():
            done.append(made)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["uri", "records", "bytes"])

    return materialize(pages.mapInArrow(write, "uri string, records long, bytes long"), "manifest")


def record_ranges(manifest: DataFrame, most: int = 8 << 20) -> DataFrame:
    """uri, offset, lengths: runs of adjacent records of up to ``most`` bytes, from each package's directory and index."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    members = {m.name: m for m in central_directory(f)}
                    data, size = stored_range(f, members[DATA])
                    at, n = stored_range(f, members[INDEX])
                    f.seek(at)
                    lines = [json.loads(x) for x in f.read(n).splitlines() if x]
                runs: list[tuple[str, int, list[int]]] = []
                end = held = -1
                for x in lines:
                    if x["offset"] + x["length"] > size:
                        raise ValueError(f"{uri}: the index points beyond its archive")
                    if x["offset"] == end and held + x["length"] <= most:
                        runs[-1][2].append(x["length"])
                        held += x["length"]
                    else:
                        runs.append((uri, data + x["offset"], [x["length"]]))
                        held = x["length"]
                    end = x["offset"] + x["length"]
                if runs:
                    u, o, n = zip(*runs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(o, pa.int64()), pa.array(n, pa.list_(pa.int64()))], names=["uri", "offset", "lengths"])

    return manifest.select("uri").mapInArrow(plan, "uri string, offset long, lengths array<long>")


_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def read_packages(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages that ``manifest`` lists by ``uri``. Without ``payloads`` they are checked but not returned."""
    fields = _FIELDS if payloads else _FIELDS[:-1]
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    f.seek(offset)
                    run = memoryview(f.read(sum(lengths)))
                at, rows = 0, []
                for n in lengths:
                    unpack = zlib.decompressobj(31)
                    rows.append(read_record(unpack.decompress(run[at : at + n]) + unpack.flush()))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], schema=schema)

    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}
    ranges = record_ranges(manifest).repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return ranges.mapInArrow(read, ", ".join(f"{k} {kinds.get(k, 'string')}" for k, _ in fields))


def roundtrip(pages: DataFrame, least: int = 1000, root: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as packages and reads them back.

    A null html is an empty payload, a null url becomes about:blank, an empty table gives no package and no rows,
    repeated rows give a record each; other columns are ignored.
    """
    manifest = write_packages(with_refers_to(pages, least), root or new_path(pages.sparkSession, "warc"))
    return read_packages(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
