"""Web archives: packages read by ranges, against zipfile, gzip and a plain choice of responses."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from fotolake.llm import archives as ar

FIELDS = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(rows, least=0):
    """Sorted (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    out, groups = [], {}
    for page_id, url, html in rows:
        groups.setdefault(html or "", []).append((page_id, url))
    for html, own in groups.items():
        n = len(html.encode())
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        for i, (page_id, _) in enumerate(own):
            first = i == len(own) - 1 or n < least
            out.append((page_id, n, digest(html), "response" if first else "revisit", None if first else own[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


ROWS = [
    (1, "http://a.example/x?y=1", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (3, "http://b.example/ü \r\nX: y", "<p>zwei ü</p>"),
    (4, None, None), (5, "http://c.example/", ""), (None, "http://d.example/", "<p>one</p>"), (None, None, None),
    (6, "http://e.example/", "x" * 300_000), (6, "http://e.example/", "x" * 300_000), (6, "http://f.example/", "x" * 300_000), (7, "no url", "\r\n\r\nWARC/1.1\r\n"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, FIELDS)
    found = ar.round_trip(pages)
    assert found.filter("NOT intact").count() == 0
    assert rows_of(found) == plain(ROWS)
    assert rows_of(ar.round_trip(pages, least=11)) == plain(ROWS, 11)


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(ROWS, FIELDS)
    read = ar.read(ar.write(ar.record_types(pages), size=100_000))
    got = {(r["page_id"], r["url"], bytes(r["payload"])) for r in read.collect() if r["record_type"] == "response"}
    wanted = {(p, u, (h or "").encode()) for p, u, h in ROWS}
    assert got < wanted and {g[2] for g in got} == {w[2] for w in wanted}
    assert read.filter("record_type = 'revisit' AND payload IS NOT NULL").count() == 0


def test_many_copies_and_empty_table(spark):
    rows = [(i, f"http://h/{i % 3}", "same" if i % 3 else f"own {i}") for i in range(400)]
    assert rows_of(ar.round_trip(spark.createDataFrame(rows, FIELDS).repartition(5))) == plain(rows)
    assert ar.round_trip(spark.createDataFrame([], FIELDS)).collect() == []
    wide = spark.createDataFrame(ROWS, FIELDS).select("*", F.lit(1).alias("key"), F.lit(2).alias("best"), F.lit("z").alias("record_type"), F.lit(0).alias("_salt"))
    assert rows_of(ar.round_trip(wide)) == plain(ROWS)


def test_standard_readers_agree(spark):
    """zipfile and gzip see the same members and records."""
    packages = ar.write(ar.record_types(spark.createDataFrame(ROWS, FIELDS).coalesce(1)))
    row = packages.collect()[0]
    path = row["path"].removeprefix("file:").replace("//", "/")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        data = z.read(ar.ARCHIVE)
        lines = z.read(ar.INDEX).decode().splitlines()
        listed = json.loads(z.read(ar.PACKAGE_FILE))["resources"]
        assert [hashlib.sha256(z.read(r["path"])).hexdigest() for r in listed] == [r["hash"].removeprefix("sha256:") for r in listed]
    assert len(lines) == row["n_records"] == len(ROWS) and lines == sorted(lines)
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    for line in lines:
        at = json.loads(line.split(" ", 2)[2])
        block = data[at["offset"] : at["offset"] + at["length"]]
        own, body, _, _ = ar.parse(block)
        assert "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() == own["warc-block-digest"]
        assert not {"x"} & set(own)  # the URL with a line break starts no field


def zip64(payload: bytes, name: bytes, comment: bytes, gap: int) -> bytes:
    """A package as a writer beyond 4 GB makes it: every number that may be is in the ZIP64 fields."""
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(payload), len(payload))
    begin = gap + len(local) + len(payload)
    extra = struct.pack("<HHI", 0x5455, 4, 7) + struct.pack("<HHQQQ", 1, 24, len(payload), len(payload), gap)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), begin)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, begin + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    return b"\0" * gap + local + payload + entry + end64 + locator + end


def test_zip64_fields(tmp_path):
    (tmp_path / "a.zip").write_bytes(zip64(b"hello", b"archive/data.warc.gz", b"a comment with PK\x05\x06 in it", 1000))
    file = ar.Ranges(str(tmp_path / "a.zip"))
    assert ar.members(file) == {"archive/data.warc.gz": (0, 5, 5, 1000)}
    assert file.read(ar.data_place(file, 1000), 5) == b"hello"


def test_more_than_65535_members(tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for i in range(65_600):
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"ends")
    file = ar.Ranges(str(tmp_path / "b.zip"))
    found = ar.members(file)
    assert len(found) == 65_601
    assert file.read(ar.data_place(file, found["last"][3]), 4) == b"ends"


def test_deflated_index_and_ranges_alone(tmp_path):
    """A package of another writer: a deflated index; only the ranges asked for are read."""
    blocks = [ar.record(i, f"http://x/{i}", bytes([65 + i]) * 10, "response", None)[0] for i in range(3)]
    unlisted = bytes(2_000_000)
    lines = [f"x {20240101000000 + i} {json.dumps({'url': f'http://x/{i}', 'filename': 'w.warc.gz', 'offset': len(unlisted) + sum(map(len, blocks[:i])), 'length': len(blocks[i])})}" for i in range(3)]
    with zipfile.ZipFile(tmp_path / "c.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/w.warc.gz", unlisted + b"".join(blocks))
        z.writestr("indexes/i.cdx.gz", gzip.compress("\n".join(lines).encode()), zipfile.ZIP_DEFLATED)
    file = ar.Ranges(str(tmp_path / "c.wacz"))
    assert [ar.parse(b)[3] for _, b in ar.blocks(file)] == [b"A" * 10, b"B" * 10, b"C" * 10]
    assert file.count < 70_000


@pytest.mark.parametrize("spoil", ["short", "end", "entry", "method"])
def test_broken_packages_are_refused(tmp_path, spoil):
    out = io.BytesIO()
    ar.package(out, iter([(1, "http://x/", b"abc", "response", None)]))
    data = out.getvalue()
    if spoil == "short":
        data = data[: len(data) // 2]
    elif spoil == "end":
        data = data[:-3]
    elif spoil == "entry":
        data = data.replace(b"PK\x01\x02", b"PK\x01\x03")
    else:
        other = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as b:
            for n in a.namelist():
                b.writestr(n, a.read(n))
        data = other.getvalue()
    (tmp_path / "d.wacz").write_bytes(data)
    with pytest.raises(ValueError):
        list(ar.blocks(ar.Ranges(str(tmp_path / "d.wacz"))))
