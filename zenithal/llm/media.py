"""Media columns and signature sniffing.

Texts are stored as media: their bytes, filled up with zeros, are the 8-bit samples of a mono WAV file in a binary column.
:func:`sniff` finds out what a binary column really holds: an Aho-Corasick automaton locates the magic bytes of all known
formats in one pass, and a validator for each format walks its structure (chunks, segments, blocks, boxes) to confirm it and
to measure its length. What starts at 0 and is valid is the type, whatever was declared; valid media further on are embedded
and can be carved out. A signature alone (say, in prose) is nothing.
"""

from __future__ import annotations

import bisect
import functools
import struct
import zlib
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.session import materialize, ship

#: Magic bytes, where they stand in a file, and its type.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WAVEfmt ", 8, "audio/wav"),
    (b"WEBPVP8", 8, "image/webp"),
    (b"AVI LIST", 8, "video/x-msvideo"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "application/ogg"),
    (b"ftyp", 4, "video/mp4"),
]
UNKNOWN = "application/octet-stream"
FOUND = "struct<type:string,length:bigint,corrected:boolean,embedded:array<struct<type:string,offset:bigint,length:bigint>>>"


def _png(d: bytes, at: int, marks: Marks) -> int:
    a = at + 8
    while a + 12 <= len(d):
        n, name = struct.unpack_from(">I4s", d, a)
        if a + 12 + n > len(d) or zlib.crc32(d[a + 4 : a + 8 + n]) != struct.unpack_from(">I", d, a + 8 + n)[0] or (a == at + 8) != (name == b"IHDR"):
            return 0
        a += 12 + n
        if name == b"IEND":
            return a - at
    return 0


def _jpeg(d: bytes, at: int, marks: Marks) -> int:
    a = at + 2
    while a + 4 <= len(d) and d[a] == 0xFF:
        mark = d[a + 1]
        if mark == 0xFF:  # a fill byte
            a += 1
            continue
        if mark < 0xC0 or 0xD0 <= mark <= 0xD8:  # stands in no head
            return 0
        if mark == 0xD9:
            return a + 2 - at
        n = struct.unpack_from(">H", d, a + 2)[0]
        if n < 2 or a + 2 + n > len(d):
            return 0
        a += 2 + n
        if mark == 0xDA:  # coded data up to the next marker that is no restart and no stuffed byte
            while (a := d.find(b"\xff", a)) >= 0 and a + 1 < len(d) and (d[a + 1] == 0 or 0xD0 <= d[a + 1] <= 0xD7):
                a += 2
            if a < 0:
                return 0
    return a + 2 - at if d[a : a + 2] == b"\xff\xd9" else 0


def _gif(d: bytes, at: int, marks: Marks) -> int:
    if at + 13 > len(d):
        return 0
    flags = d[at + 10]
    a = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    walked, path = marks.blocks, []
    while a < len(d) and not walked[a]:
        path.append(a)
        if d[a] == 0x3B:
            found = a + 2
            break
        if d[a] == 0x2C and a + 10 < len(d):
            start = a + 11 + (3 << (d[a + 9] & 7) + 1 if d[a + 9] & 0x80 else 0)
        elif d[a] == 0x21:
            start = a + 2
        else:
            found = 1
            break
        a = marks.after_sub_blocks(start)
    else:
        found = walked[a] if a < len(d) else 1
    for p in path:
        walked[p] = found
    return found - 1 - at if found > 1 else 0


def _bmp(d: bytes, at: int, marks: Marks) -> int:
    if at + 26 > len(d):
        return 0
    size, reserved, start, head = struct.unpack_from("<IIII", d, at + 2)
    return size if reserved == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(d) - at else 0


def _riff(d: bytes, at: int, marks: Marks) -> int:
    if d[at : at + 4] != b"RIFF":
        return 0
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    a = at + 12
    while a + 8 <= end <= len(d):
        a += 8 + (n := struct.unpack_from("<I", d, a + 4)[0]) + n % 2
    return end - at if a >= end and a - end < 2 and end <= len(d) else 0


class Marks(dict):
    """Where a byte string stands in a payload, found once for all of its validators."""

    def __init__(self, data: bytes):
        super().__init__()
        self.data, self.dead = data, set()

    def __missing__(self, mark: bytes) -> list[int]:
        found, at = [], self.data.find(mark)
        while at >= 0:
            found.append(at)
            at = self.data.find(mark, at + 1)
        self[mark] = found
        return found

    def after(self, mark: bytes, at: int) -> int:
        """The first place at or after ``at``, or -1."""
        i = bisect.bisect_left(self[mark], at)
        return self[mark][i] if i < len(self[mark]) else -1

    @functools.cached_property
    def blocks(self) -> array:
        """For each place where a walk over GIF blocks has been what it found: 1 nothing, else the end of the picture and 1."""
        return array("q", bytes(8 * (len(self.data) + 1)))

    @functools.cached_property
    def chains(self) -> array:
        """For each place where a walk over sub-blocks has been the place of their end, and 1."""
        return array("q", bytes(8 * (len(self.data) + 1)))

    def after_sub_blocks(self, a: int) -> int:
        """The place behind a chain of sub-blocks that begins at ``a``; no place is walked twice, whatever chains meet there."""
        d, ends, path = self.data, self.chains, []
        while a < len(d) and d[a] and not ends[a]:
            path.append(a)
            a += 1 + d[a]
        end = ends[a] - 1 if a < len(d) and ends[a] else min(a, len(d))
        for p in path:
            ends[p] = end + 1
        return end + 1

    @functools.cached_property
    def pages(self) -> dict[int, int]:
        """For each Ogg page that a walk has been at the end of its stream, 0 if it has none."""
        return {}

    @functools.cached_property
    def archives(self) -> dict[int, int]:
        """Where each ZIP archive begins and ends, by the end records that fit."""
        d, out = self.data, {}
        for a in self[b"PK\x05\x06"]:
            if a + 22 > len(d):
                break
            size, start, note = struct.unpack_from("<IIH", d, a + 12)
            at = a - size - start
            if at >= 0 and a + 22 + note <= len(d) and (d[at + start : at + start + 4] == b"PK\x01\x02" or not size):
                out.setdefault(at, a + 22 + note)
        return out


def _pdf(d: bytes, at: int, marks: Marks) -> int:
    if not d[at + 5 : at + 6].isdigit() or (end := marks.after(b"%%EOF", at)) < 0:
        return 0
    following, ends = marks.after(b"%PDF-", at + 5), marks[b"%%EOF"]
    end = max(end, ends[(bisect.bisect_left(ends, following) if following >= 0 else len(ends)) - 1])
    return end + 5 - at if 0 <= marks.after(b"startxref", at) <= end - 9 else 0


def _zip(d: bytes, at: int, marks: Marks) -> int:
    return marks.archives.get(at, at) - at


def _gzip(d: bytes, at: int, marks: Marks) -> int:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return 0
    flags, a = d[at + 3], at + 10
    if flags & 4:
        a += 2 + struct.unpack_from("<H", d, a)[0]
    for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):  # name and comment end with a zero
        if (a := marks.after(b"\0", a) + 1) == 0:
            return 0
    if a + (2 if flags & 2 else 0) >= len(d) or d[a + (2 if flags & 2 else 0)] & 6 == 6:  # no such block
        return 0
    z, a = zlib.decompressobj(31), at
    try:
        while a < len(d) and not z.eof:  # in parts, so a bomb is never held whole
            part = z.unconsumed_tail or d[a : a + 65536]
            a += 0 if z.unconsumed_tail else len(part)
            z.decompress(part, 1 << 20)
    except zlib.error:
        return 0
    return a - len(z.unused_data) - at if z.eof else 0


def _flac(d: bytes, at: int, marks: Marks) -> int:
    a, first = at + 4, True
    while a + 4 <= len(d):
        kind, n = d[a], int.from_bytes(d[a + 1 : a + 4], "big")
        if first and (kind & 0x7F or n != 34):
            return 0
        first, a = False, a + 4 + n
        if kind & 0x80:
            return len(d) - at if d[a : a + 1] == b"\xff" and d[a + 1 : a + 2] and d[a + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(d: bytes, at: int, marks: Marks) -> int:
    a, path, found = at, [], 0
    while d[a : a + 4] == b"OggS" and a + 27 <= len(d):
        if a in marks.pages:
            found = marks.pages[a]
            break
        path.append(a)
        table = d[a + 27 : a + 27 + d[a + 26]]
        end = a + 27 + len(table) + sum(table)
        if len(table) < d[a + 26] or end > len(d) or d[a + 4]:
            break
        if d[a + 5] & 4:  # the last page of a stream
            found = end
            break
        a = end
    for p in path:
        marks.pages[p] = found
    return found - at if found else 0


def _mp4(d: bytes, at: int, marks: Marks) -> int:
    a, names, starts = at, [], []
    while a + 8 <= len(d) and a not in marks.dead:
        n, name = struct.unpack_from(">I4s", d, a)
        if n == 1 and a + 16 <= len(d):
            n = struct.unpack_from(">Q", d, a + 8)[0]
        if n < 8 or a + n > len(d) or not all(32 <= c < 127 or c == 0xA9 for c in name):
            break
        names.append(name)
        starts.append(a)
        a += n
    if names[:1] == [b"ftyp"] and b"moov" in names:
        return a - at
    marks.dead.update(starts)  # nor is there one that begins within this row of boxes
    return 0


VALID = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _riff, "image/webp": _riff, "video/x-msvideo": _riff, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "application/ogg": _ogg, "video/mp4": _mp4,
}


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, at, kind in SIGNATURES:
        a.add_word(magic.decode("latin-1"), (len(magic), at, kind))
    a.make_automaton()
    return a


def inspect(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every valid medium in ``data`` that is not inside an earlier one of them, but for those
    inside the payload of a container at 0, which are reported too."""
    hits = []
    for end, (n, at, kind) in automaton().iter(data.decode("latin-1")):
        if (start := end + 1 - n - at) >= 0:
            hits.append((start, kind))
    out: list[tuple[int, int, str]] = []
    covered, marks = 0, Marks(data)
    for start, kind in sorted(hits):
        if start >= covered and (length := VALID[kind](data, start, marks)):
            out.append((start, length, kind))
            covered = start + length if start else 1
    return out


def sniff_one(data: bytes | None, declared: str | None) -> dict:
    found = inspect(data or b"")
    top = found[0] if found and not found[0][0] else None
    kind = top[2] if top else UNKNOWN
    return {"type": kind, "length": top[1] if top else 0, "corrected": kind != (declared or UNKNOWN), "embedded": [{"type": k, "offset": a, "length": n} for a, n, k in found if a]}


def sniff(df: DataFrame, content: str = "media", declared: str = "declared", out: str = "found") -> DataFrame:
    """``df`` plus ``out`` (type, length, whether the declared type was wrong, embedded media). Null or empty content and what
    fits no format is application/octet-stream of length 0."""
    ship(df.sparkSession)

    @F.arrow_udf(FOUND)
    def run(data: pa.Array, said: pa.Array) -> pa.Array:
        rows = [sniff_one(d.as_py(), s.as_py()) for d, s in zip(data, said, strict=True)]
        inner = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        return pa.array(rows, pa.struct([("type", pa.string()), ("length", pa.int64()), ("corrected", pa.bool_()), ("embedded", inner)]))

    return df.withColumn(out, run(F.col(content).cast("binary"), F.col(declared)))


def carve(df: DataFrame, content: str = "media", found: str = "found") -> DataFrame:
    """A row for each embedded medium: the columns of ``df`` and ``carved_type``, ``carved_offset``, ``carved`` (its bytes), in
    place of columns of these names. Rows without embedded media, or with null content, give none."""
    keep = [c for c in df.columns if c not in ("carved_type", "carved_offset", "carved")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("d"), F.explode(F.col(f"`{found}`")["embedded"]).alias("e"))
    cut = F.expr(f"substring(d.`{content}`, cast(e.offset + 1 as int), cast(e.length as int))")
    return rows.select(*[F.col(f"d.`{c}`").alias(c) for c in keep], F.col("e.type").alias("carved_type"), F.col("e.offset").alias("carved_offset"), cut.alias("carved"))


def to_wav(data: bytes, unit: int = 64, rate: int = 8000) -> bytes:
    """``data`` and zeros up to a positive multiple of ``unit`` as unsigned 8-bit mono samples."""
    payload = data + bytes(-len(data) % unit or (0 if data else unit))
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a file of :func:`to_wav`, by its chunks."""
    a = 12
    while a + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, a)
        if name == b"data":
            return media[a + 8 : a + 8 + n]
        a += 8 + n + n % 2
    raise ValueError("no samples")


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str = UNKNOWN) -> DataFrame:
    """(key, n_bytes, declared, media): whole texts as WAV files, written to the shared folder. Null texts are empty."""
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def wrap(t: pa.Array) -> pa.Array:
        return pa.array([to_wav(x or b"") for x in t.to_pylist()], pa.binary())

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), F.length(body).cast("long").alias("n_bytes"), F.lit(declared).alias("declared"), wrap(body).alias("media"))
    return materialize(rows, "media")


def features(media: DataFrame) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from stored media."""
    ship(media.sparkSession)

    @F.arrow_udf("binary")
    def samples(m: pa.Array) -> pa.Array:
        return pa.array([from_wav(x) for x in m.to_pylist()], pa.binary())

    rows = sniff(media, "media", "declared").withColumn("payload", samples("media"))
    inner = F.array_join(F.transform(F.col("found.embedded"), lambda e: F.concat_ws("@", e["type"], e["offset"].cast("string"), e["length"].cast("string"))), ",")
    feature = F.concat_ws(";", F.concat(F.lit("type="), F.col("found.type")), F.concat(F.lit("length="), F.col("found.length")), F.concat(F.lit("corrected="), F.col("found.corrected")), F.concat(F.lit("embedded="), inner))
    tail = F.crc32(F.expr("substring(payload, length(payload) - 63, 64)"))
    return rows.select(
        "key", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a medium, read back and sniffed."""
    stored = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return features(stored).withColumnRenamed("key", "doc_id")
