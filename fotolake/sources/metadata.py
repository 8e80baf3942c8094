"""Tags from image file headers: PNG chunks and text, JPEG segments, TIFF directories.

One Arrow job over a file listing.  Parsers see a file as something that is sliced; pages of it are read when a slice
needs them, so the bytes of pixels are never read, wherever in the file a directory lies.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.paths import strip_file_scheme

TAG_SCHEMA = "path string, tag string, value string, type string"

# Numbers of the common directory tags and their names.
IFD_TAGS = {
    0x0100: "Exif_Image_ImageWidth", 0x0101: "Exif_Image_ImageLength", 0x0103: "Exif_Image_Compression",
    0x010E: "Exif_Image_ImageDescription", 0x010F: "Exif_Image_Make", 0x0110: "Exif_Image_Model",
    0x0112: "Exif_Image_Orientation", 0x011A: "Exif_Image_XResolution", 0x011B: "Exif_Image_YResolution",
    0x0128: "Exif_Image_ResolutionUnit", 0x0131: "Exif_Image_Software", 0x0132: "Exif_Image_DateTime",
    0x013B: "Exif_Image_Artist", 0x8298: "Exif_Image_Copyright",
    0x829A: "Exif_Photo_ExposureTime", 0x829D: "Exif_Photo_FNumber", 0x8827: "Exif_Photo_ISOSpeedRatings",
    0x9003: "Exif_Photo_DateTimeOriginal", 0x9004: "Exif_Photo_DateTimeDigitized",
    0x9209: "Exif_Photo_Flash", 0x920A: "Exif_Photo_FocalLength", 0x9286: "Exif_Photo_UserComment",
    0xA002: "Exif_Photo_PixelXDimension", 0xA003: "Exif_Photo_PixelYDimension",
}
GPS_TAGS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude",
            5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 18: "GPSMapDatum", 29: "GPSDateStamp"}
IPTC_TAGS = {5: "ObjectName", 25: "Keywords", 55: "DateCreated", 80: "Byline", 90: "City",
             101: "CountryName", 105: "Headline", 116: "Copyright", 120: "Caption"}
SUB_DIRECTORIES = {0x8769: IFD_TAGS, 0x8825: None}
# Directory entry type -> (bytes, struct code, name).
KINDS = {1: (1, "B", "int"), 2: (1, "s", "str"), 3: (2, "H", "int"), 4: (4, "I", "int"), 5: (8, "II", "rational"),
         6: (1, "b", "int"), 7: (1, "s", "bytes"), 8: (2, "h", "int"), 9: (4, "i", "int"), 10: (8, "ii", "rational"),
         11: (4, "f", "float"), 12: (8, "d", "float")}
PNG_CHUNKS = {b"tEXt", b"pHYs", b"gAMA", b"tRNS", b"eXIf"}
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


class Pages:
    """A file that is read by pages, like bytes to a parser."""

    SIZE, MOST = 4096, 1 << 20

    def __init__(self, file, length: int) -> None:
        self.file, self.length, self.pages, self.count = file, length, {}, 0

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, at):
        if isinstance(at, int):
            return self[at:at + 1][0]
        start, stop, _ = at.indices(self.length)
        if stop <= start:
            return b""
        if stop - start > self.MOST:  # larger than any tag: the header is broken
            raise ValueError("a tag of this length is none")
        first, last = start // self.SIZE, (stop - 1) // self.SIZE
        for p in range(first, last + 1):
            if p not in self.pages:
                self.file.seek(p * self.SIZE)
                self.pages[p] = self.file.read(min(self.SIZE, self.length - p * self.SIZE))
                self.count += len(self.pages[p])
        data = b"".join(self.pages[p] for p in range(first, last + 1))
        return data[start - first * self.SIZE:stop - first * self.SIZE]


def _unpack(kinds: str, buf, at: int) -> tuple:
    return struct.unpack(kinds, buf[at:at + struct.calcsize(kinds)])


def _entry(buf, order: str, kind: int, count: int, at: int):
    size, code, name = KINDS[kind]
    raw = buf[at:at + size * count]
    if name in ("str", "bytes"):
        return raw.split(b"\0")[0].decode("utf-8", "replace"), name
    n = struct.unpack(order + code * count, raw)
    if name == "rational":
        return " ".join(f"{a}/{b}" for a, b in zip(n[::2], n[1::2])), name
    return " ".join(map(str, n)), name


def _directory(buf, order: str, at: int, names: dict, prefix: str = "", seen: frozenset = frozenset()):
    if at in seen:  # a directory that leads back to itself
        return
    (count,) = _unpack(order + "H", buf, at)
    for i in range(count):
        tag, kind, n, value = _unpack(order + "HHII", buf, at + 2 + 12 * i)
        if tag in SUB_DIRECTORIES:
            sub = SUB_DIRECTORIES[tag]
            yield from _directory(buf, order, value, sub or GPS_TAGS, "" if sub else "Exif_GPSInfo_", seen | {at})
        elif tag in names and kind in KINDS:
            where = value if KINDS[kind][0] * n > 4 else at + 2 + 12 * i + 8
            if where + KINDS[kind][0] * n > len(buf):  # a count that the file cannot hold
                continue
            yield (prefix + names[tag], *_entry(buf, order, kind, n, where))


def _tiff(buf):
    order = "<" if buf[:2] == b"II" else ">"
    (at,) = _unpack(order + "I", buf, 4)
    yield from _directory(buf, order, at, IFD_TAGS)


def _image(fmt: str, width: int, height: int, mode: str):
    yield from (("format", fmt, "str"), ("width", str(width), "int"), ("height", str(height), "int"),
                ("size", f"{width} {height}", "tuple"), ("mode", mode, "str"),
                ("aspect", str(width / height), "float"))


def _png(buf):
    w, h, _, colour = _unpack(">IIBB", buf, 16)
    yield from _image("PNG", w, h, PNG_MODES.get(colour, "?"))
    yield "interlace", str(buf[28]), "int"
    at = 8
    while at + 8 <= len(buf):
        n, name = _unpack(">I4s", buf, at)
        if name == b"IEND":
            return
        body = buf[at + 8:at + 8 + n] if name in PNG_CHUNKS else b""
        if name == b"tEXt" and b"\0" in body:
            key, text = body.split(b"\0", 1)
            yield "Png_" + key.decode("latin-1").replace(" ", "_"), text.decode("latin-1"), "str"
        elif name == b"pHYs" and body[8] == 1:
            yield "dpi", str(round(struct.unpack(">I", body[:4])[0] * 0.0254)), "int"
        elif name == b"gAMA":
            yield "gamma", str(struct.unpack(">I", body)[0] / 100000), "float"
        elif name == b"tRNS":
            yield "transparency", "1", "int"
        elif name == b"eXIf":
            yield from _tiff(body)
        at += 12 + n


def _iptc(body: bytes):
    at = body.find(b"\x1c\x02")
    while 0 <= at and at + 5 <= len(body) and body[at:at + 2] == b"\x1c\x02":
        n = _unpack(">H", body, at + 3)[0]
        if body[at + 2] in IPTC_TAGS:
            yield "Iptc_Application2_" + IPTC_TAGS[body[at + 2]], body[at + 5:at + 5 + n].decode("utf-8", "replace"), "str"
        at += 5 + n


def _jpeg(buf):
    at = 2
    while at + 4 <= len(buf) and buf[at] == 0xFF:
        marker, n = buf[at + 1], _unpack(">H", buf, at + 2)[0]
        if marker == 0xDA:
            return
        body = buf[at + 4:at + 2 + n]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            yield from _tiff(body[6:])
        elif marker == 0xE0 and body[:5] == b"JFIF\0" and body[7] == 1:
            yield "dpi", str(struct.unpack(">H", body[8:10])[0]), "int"
        elif marker == 0xED:
            yield from _iptc(body)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w, bands = struct.unpack(">HHB", body[1:6])
            yield from _image("JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(bands, "?"))
        at += 2 + n


def parse_header(buf) -> list[tuple[str, str, str]]:
    """(tag, value, type) of one file; a broken header gives what came before the break."""
    out = []
    try:
        if buf[:8] == b"\x89PNG\r\n\x1a\n":
            source = _png(buf)
        elif buf[:2] == b"\xff\xd8":
            source = _jpeg(buf)
        elif buf[:4] in (b"II*\0", b"MM\0*"):
            source = _tiff(buf)
        else:
            return out
        for item in source:
            out.append(item)
    except (struct.error, IndexError, KeyError, ValueError, ZeroDivisionError):
        pass
    return out


def header_tags(path: str) -> tuple[list[tuple[str, str, str]], int]:
    """(tag, value, type) of a file, and how many of its bytes were read."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with where.open_input_file(at) as file:
        pages = Pages(file, file.size())
        return parse_header(pages), pages.count


def read_tags(files: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Long tag rows of a listing with ``path``; of ``tags`` alone where they are given.  Rows that were read already
    (``content`` of ``binaryFile``) are parsed as they are.  A file that is gone by now has no tags."""
    names, wanted = ["path", "tag", "value", "type"], None if tags is None else set(tags)
    here = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, path in enumerate(b.column(0).to_pylist()):
                try:
                    found = parse_header(b.column(1)[i].as_py()) if here else header_tags(path)[0]
                except OSError:
                    continue
                rows += [(path, *t) for t in found if wanted is None or t[0] in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 4)], names)

    path = strip_file_scheme(F.col("path")).alias("path")
    return files.select(path, *(["content"] if here else [])).mapInArrow(run, TAG_SCHEMA)
