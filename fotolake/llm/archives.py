"""Web archives in ZIP packages: written by Spark tasks, read back by byte ranges.

A package is a ZIP file with stored members: `archive/data.warc.gz` (a compressed block for each record),
`indexes/index.cdxj` (a line for each record: where its block begins, how long it is) and `datapackage.json`.

The reader never extracts a member. It reads the file's tail for the end record, with ZIP64 also the locator and the end
record it points to, then the central directory; offsets and sizes that do not fit 32 bits are in a member's ZIP64 field.
A member's data begin after its local header. The index gives the ranges of records inside the archive member; ranges
that follow each other are read together, up to SPAN bytes, so memory is bounded by one span and one record.

Of records with equal payloads the one with the largest page id (then the largest URL) is a response, the others revisit
it; payloads under `least` bytes are responses all. Equal payloads are counted first; their rows are spread over SALTS
places for each payload, so that a page with very many copies meets in no task.

Files are written under a name of their own and moved when whole; the rows of the written table name them, so files of
lost or repeated tasks are never read. NULL payloads are empty, NULL ids and URLs stay NULL (and are smaller than all
others), repeated rows are records of their own, other columns are left out, empty tables give no package.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import _filesystem, shared_folder, written
from fotolake.operators.skew import salted_lookup

#: Bytes of payload in a package, bytes read at once, bytes of a result's batch.
PACKAGE, SPAN, CHUNK = 64 << 20, 4 << 20, 8 << 20
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX, PACKAGE_FILE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Fixed values of the ZIP format.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_NONE16, _NONE32 = 0xFFFF, 0xFFFFFFFF


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Which records are responses


def record_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (never NULL), record_type and refers_to."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = base.withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    large = keyed.filter(F.octet_length("html") >= least)
    equal = written(large.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n")).filter("n > 1").select("key", "best"))
    if equal.isEmpty():
        return base.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    here: Column = F.xxhash64("page_id", "url")
    found = salted_lookup(keyed, equal, ["key"], here, "left", SALTS)
    single = F.col("best").isNull()
    # rows that are the same in all: the first of them; pages without equals are left in their place by their own id
    chosen = F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    place = F.row_number().over(Window.partitionBy("key", F.pmod(here, F.lit(SALTS)), "page_id", "url").orderBy(F.lit(1)))
    alone = found.filter(single).select("page_id", "url", "html", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    copies = found.filter(~single).withColumn("first", chosen & (place == 1))
    kind = F.when(F.col("first"), "response").otherwise("revisit")
    return alone.unionByName(copies.select("page_id", "url", "html", kind.alias("record_type"), F.when(~F.col("first"), F.col("best.page_id")).alias("refers_to")))


# Writing


def _surt(url: str | None) -> str:
    """Host parts from the last to the first, then the path."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "-"
    rest = parts.path + ("?" + parts.query if parts.query else "")
    return quote(",".join(reversed(host.split("."))) + ")" + (rest or "/"), safe=",)/?&=%+:;@") if host else "-"


def _headers(first: str, fields: list[tuple[str, object]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = DATE) -> tuple[bytes, str]:
    """A compressed WARC record and its payload digest. A revisit has the reply's headers and no payload."""
    digest = base32_sha1(payload)
    reply = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    body = reply + payload if kind == "response" else reply
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    head = _headers("WARC/1.1", [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + digest), ("WARC-Block-Digest", "sha1:" + base32_sha1(body)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("Page-ID", page_id), ("Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(body)),
    ])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush(), digest


@contextmanager
def _target(folder: str, name: str) -> Iterator[BinaryIO]:
    """A file that appears under its name when it is whole."""
    fs, path = _filesystem(folder)
    part = f"{path}/.{name}.part"
    if fs is None:
        os.makedirs(path, exist_ok=True)
        with open(part, "wb") as out:
            yield out
        os.replace(part, f"{path}/{name}")
    else:
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(part) as out:
            yield out
        fs.move(part, f"{path}/{name}")


class _Counted(io.RawIOBase):
    """Passes bytes on and keeps their number and digest."""

    def __init__(self, to: BinaryIO) -> None:
        self.to, self.size, self.sha = to, 0, hashlib.sha256()

    def write(self, data) -> int:
        self.to.write(data)
        self.size += len(data)
        self.sha.update(data)
        return len(data)


def package(out: BinaryIO, rows: Iterator[tuple], date: str = DATE) -> int:
    """Writes rows(page_id, url, payload, kind, refers_to) as one package; their number."""
    lines, resources = [], []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:

        def member(name: str):
            return z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)

        with member(ARCHIVE) as to:
            archive = _Counted(to)
            for page_id, url, payload, kind, refers_to in rows:
                block, digest = record(page_id, url, payload, kind, refers_to, date)
                at = {"url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "status": "200", "digest": "sha1:" + digest, "length": len(block), "offset": archive.size, "filename": ARCHIVE.rpartition("/")[2]}
                lines.append(f"{_surt(url)} {''.join(c for c in date if c.isdigit())} {json.dumps(at)}\n")
                archive.write(block)
        resources.append({"name": "data.warc.gz", "path": ARCHIVE, "bytes": archive.size, "hash": "sha256:" + archive.sha.hexdigest()})
        index = "".join(sorted(lines)).encode()
        with member(INDEX) as to:
            to.write(index)
        resources.append({"name": "index.cdxj", "path": INDEX, "bytes": len(index), "hash": "sha256:" + hashlib.sha256(index).hexdigest()})
        with member(PACKAGE_FILE) as to:
            to.write(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": resources}, indent=1).encode())
    return len(lines)


def write(records: DataFrame, folder: str | None = None, *, size: int = PACKAGE) -> DataFrame:
    """Packages of records(page_id, url, html, record_type, refers_to); a row (path, n_records) for each, written."""
    folder = folder or shared_folder(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    page_id, url, html, kind, refers_to = (c[i].as_py() for c in b.columns)
                    yield page_id, url, html.encode(), kind, refers_to

        def some() -> Iterator[tuple]:
            """Rows until the package is full."""
            nonlocal ahead
            held = 0
            while ahead is not None and held < size:
                held += len(ahead[2])
                yield ahead
                ahead = next(source, None)

        source = rows()
        ahead = next(source, None)
        while ahead is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            with _target(folder, name) as out:
                n = package(out, some())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return written(records.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "path string, n_records long"))


# Reading


class Ranges:
    """Byte ranges of a file, and how many bytes were read."""

    def __init__(self, path: str) -> None:
        fs, name = _filesystem(path)
        self.path, self.count = path, 0
        self.file = open(name, "rb") if fs is None else fs.open_input_file(name)
        self.size = self.file.seek(0, 2) if fs is None else self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError(f"{self.path}: bytes {at} to {at + n} lie outside the file")
        self.file.seek(at)
        data = self.file.read(n)
        self.count += len(data)
        if len(data) != n:
            raise ValueError(f"{self.path}: cut short")
        return data

    def close(self) -> None:
        self.file.close()


def _directory_place(file: Ranges) -> tuple[int, int, int]:
    """Where the central directory begins, its length and number of entries."""
    # the end record has 22 bytes and a comment of up to 65,535
    start = max(0, file.size - 22 - 0xFFFF)
    tail = file.read(start, file.size - start)
    at = len(tail) - 22
    while at >= 0:
        at = tail.rfind(_END, 0, at + 4)
        if at < 0 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError(f"{file.path}: no end of a ZIP directory")
    entries, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if _NONE16 in (entries,) or _NONE32 in (length, begin):
        where = start + at - 20
        locator = file.read(where, 20) if where >= 0 else b""
        if locator[:4] == _LOCATOR64:
            end = struct.unpack_from("<Q", locator, 8)[0]
            record64 = file.read(end, 56)
            if record64[:4] != _END64:
                raise ValueError(f"{file.path}: no ZIP64 end record where its locator points")
            entries, length, begin = struct.unpack_from("<QQQ", record64, 32)
    return begin, length, entries


def members(file: Ranges) -> dict[str, tuple[int, int, int, int]]:
    """Of each member: method, stored length, whole length, place of its local header."""
    begin, length, entries = _directory_place(file)
    data, at, found = file.read(begin, length), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != _ENTRY:
            raise ValueError(f"{file.path}: the ZIP directory is broken")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, whole, n_name, n_extra, n_comment, disk = struct.unpack_from("<IIHHHH", data, at + 20)
        place = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name]
        extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: only what does not fit, in this order
                long = [struct.unpack_from("<Q", extra, e + 4 + i)[0] for i in range(0, n - n % 8, 8)]
                whole = long.pop(0) if whole == _NONE32 else whole
                packed = long.pop(0) if packed == _NONE32 else packed
                place = long.pop(0) if place == _NONE32 else place
            e += 4 + n
        if flags & 1:
            raise ValueError(f"{file.path}: {name!r} is encrypted")
        found[name.decode("utf-8" if flags & 0x800 else "cp437")] = method, packed, whole, place
        at += 46 + n_name + n_extra + n_comment
    return found


def data_place(file: Ranges, local: int) -> int:
    """Where a member's data begin: its local header may have other extra fields than the directory."""
    head = file.read(local, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"{file.path}: no member at {local}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + n_name + n_extra


def index_lines(file: Ranges, found: dict[str, tuple[int, int, int, int]]) -> Iterator[dict]:
    """The entries of all indexes, stored or deflated."""
    for name, (method, packed, _, local) in found.items():
        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx", ".cdx.gz", ".cdxj.gz")):
            data = file.read(data_place(file, local), packed)
            if method == 8:
                data = zlib.decompress(data, -15)
            elif method:
                raise ValueError(f"{file.path}: {name} has method {method}")
            if name.endswith(".gz"):
                data = zlib.decompress(data, 31)
            for line in data.decode().splitlines():
                if line and not line.startswith("!"):
                    yield json.loads(line.split(" ", 2)[2])


def blocks(file: Ranges) -> Iterator[tuple[dict, bytes]]:
    """Index entries and their compressed records, in order of place."""
    found = members(file)
    starts: dict[str, tuple[int, int]] = {}
    entries = []
    for e in index_lines(file, found):
        name = "archive/" + e["filename"]
        if name not in starts:
            if name not in found:
                raise ValueError(f"{file.path}: {name} is missing")
            method, packed, _, local = found[name]
            if method:
                raise ValueError(f"{file.path}: {name} is not stored")
            starts[name] = data_place(file, local), packed
        begin, packed = starts[name]
        at, n = int(e["offset"]), int(e["length"])
        if at + n > packed:
            raise ValueError(f"{file.path}: a record reaches beyond {name}")
        entries.append((begin + at, n, e))
    entries.sort(key=lambda x: x[0])
    i = 0
    while i < len(entries):
        k, end = i, entries[i][0]
        while k < len(entries) and entries[k][0] == end and (k == i or end + entries[k][1] - entries[i][0] <= SPAN):
            end += entries[k][1]
            k += 1
        if k == i:  # overlapping entries: alone
            k, end = i + 1, entries[i][0] + entries[i][1]
        data = file.read(entries[i][0], end - entries[i][0])
        for at, n, e in entries[i:k]:
            yield e, data[at - entries[i][0] : at - entries[i][0] + n]
        i = k


def parse(block: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """A record's fields, its block, the reply's headers and the payload."""
    data = zlib.decompress(block, 31)

    def fields(head: bytes) -> dict[str, str]:
        return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    own = fields(head)
    body = rest[: int(own["content-length"])]
    reply, _, payload = body.partition(b"\r\n\r\n")
    return own, body, fields(reply), payload


def read(packages: DataFrame, *, payload: bool = True, opened: Callable[[str], Ranges] = Ranges) -> DataFrame:
    """The records of packages(path): page_id, url, record_type, refers_to, payload_bytes and payload_digest of the full payload,
    `intact` (what is there agrees with the digests) and, if wanted, the payload (NULL for revisits)."""
    spark = packages.sparkSession
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), *([("payload", pa.binary())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heavy = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for path in (p for b in batches for p in b.column(0).to_pylist()):
            file = opened(path)
            try:
                for entry, block in blocks(file):
                    own, body, reply, found = parse(block)
                    kind, digest = own["warc-type"], own["warc-payload-digest"].removeprefix("sha1:")
                    intact = own["warc-block-digest"] == "sha1:" + base32_sha1(body) and (kind == "revisit" or base32_sha1(found) == digest)
                    number = lambda name: int(own[name]) if name in own else None  # noqa: B023, E731
                    row = (number("page-id"), entry["url"], kind, number("refers-to-page-id"), int(reply["content-length"]), digest, intact)
                    held.append((*row, found if kind == "response" else None) if payload else row)
                    heavy += 200 + (len(found) if payload else 0)
                    if heavy >= CHUNK:
                        yield batch()
                        held, heavy = [], 0
            finally:
                file.close()
        if held:
            yield batch()

    kinds = {"page_id": "long", "refers_to": "long", "payload_bytes": "long", "intact": "boolean", "payload": "binary"}
    tasks = max(1, min(packages.count(), 64 * spark.sparkContext.defaultParallelism))
    return packages.select("path").repartition(tasks).mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in schema.names))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """What is read of the archives written of pages(page_id, url, html)."""
    return read(write(record_types(pages, least)), payload=False)
