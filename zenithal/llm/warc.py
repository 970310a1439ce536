"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some 256 KB of whole records, and a last skippable frame: the
seek table with the compressed and decompressed size of every frame. Any Zstandard reader reads a bundle from start to end;
with the table a reader fetches single frames. The index gives for every record identifier its bundle, the frame's place in
it, and the record's offset relative to the start of the frame's contents.

Records with equal payloads of at least ``revisit_bytes`` are written once: the one with the largest id is the response, the
others are revisits that name it. Bundles are written where their rows are. Payloads are only shuffled, by their digest, to
learn whether they repeat: those of less than ``revisit_bytes`` are not, nor are those of the most frequent payloads, whose
digests are broadcast. A failed attempt leaves a file that no index row names. A url is written as it is, but for line breaks,
which no header can hold: they become %0D and %0A.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.llm import files
from zenithal.llm.skew import join_counted
from zenithal.session import materialize, shared_dir, ship

FRAME_BYTES, BUNDLE_BYTES, REVISIT_BYTES = 256 << 10, 64 << 20, 1000
#: Fixed values of the seekable format: magic of the skippable frame, magic at the end, flag for checksums.
SKIP_MAGIC, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed value: the revisit profile of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id long, path string, frame_offset long, frame_bytes long, offset long, length long"
RECORD = "record_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _urn(record_id: int | None) -> str:
    return f"<urn:x-page:{'' if record_id is None else record_id}>"


def _from_urn(urn: str) -> int | None:
    return int(x) if (x := urn[1:-1].rpartition(":")[2]) else None


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block has the HTTP head only."""
    digest = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` as a row of RECORD, and where the next one begins."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    start = stop + 4
    end = start + int(h["content-length"])
    body = data.index(b"\r\n\r\n", start, end) + 4
    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in data[start : body - 4].decode().split("\r\n")[1:])}
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:"))
    kind, payload = h["warc-type"], data[body:end]
    size = int(http["content-length"])
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).digest() != digest:
            raise ValueError("a record's payload differs from its digest")
    url = h.get("warc-target-uri")
    row = {
        "record_id": _from_urn(h["warc-record-id"]), "url": url, "record_type": kind, "payload_bytes": size,
        "payload_digest": digest.hex(), "refers_to": _from_urn(h["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }
    return row, end + 4


class Bundle:
    """Collects records; ``close`` gives the file's bytes, ``index`` the rows of INDEX without the path."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.size, self.index = frame_bytes, 0, []
        self._frames, self._open, self._held, self._table = [], [], 0, []

    def add(self, record_id: int | None, data: bytes) -> None:
        self._open.append((record_id, self._held, len(data), data))
        self._held += len(data)
        if self._held >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self._open:
            plain = b"".join(x[3] for x in self._open)
            packed = zstandard.ZstdCompressor(level=3).compress(plain)
            self.index += [(i, self.size, len(packed), a, n) for i, a, n, _ in self._open]
            self._table.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self._frames.append(packed)
            self.size += len(packed)
            self._open, self._held = [], 0

    def close(self) -> bytes:
        self._flush()
        table = b"".join(self._table) + struct.pack("<IBI", len(self._table), CHECKSUMS, SEEK_MAGIC)
        return b"".join([*self._frames, struct.pack("<II", SKIP_MAGIC, len(table)), table])


def seek_table(uri: str) -> list[tuple[int, int, int, int]]:
    """(offset, compressed, decompressed, checksum) of every frame, read from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", files.tail(uri, 9))
    if magic != SEEK_MAGIC or not flags & CHECKSUMS:
        raise ValueError("no seek table at the end of the bundle")
    out, at = [], 0
    for packed, plain, check in struct.iter_unpack("<III", files.tail(uri, 9 + 12 * n)[:-9]):
        out.append((at, packed, plain, check))
        at += packed
    return out


def write_bundles(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` to bundles in ``folder``; returns the index, one row for each record.

    A null html is an empty payload, a null url leaves its header out. Other columns are not read. Rows that repeat the largest id of their payload are responses, too, as are rows with a
    null id. An empty table writes nothing and gives an empty index.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    hashed = rows.withColumn("sha", F.when(F.length("payload") >= revisit_bytes, F.sha2("payload", 256)))
    # Counted before the shuffle; only payloads that repeat are kept, so the table is small unless most pages are copies.
    again = hashed.where("sha is not null").groupBy("sha").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = join_counted(hashed, materialize(again, "warc-again"), "sha", "n", "left")
    judged = judged.select("key", "url", "payload", F.when(F.col("key") < F.col("last"), F.col("last")).alias("refers_to"))

    def write(batches):
        bundle, part = Bundle(frame_bytes), TaskContext.get().partitionId()

        def close():
            uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.zst"
            files.write(uri, bundle.close())
            columns = list(zip(*bundle.index, strict=True))
            arrays = [pa.array(x, pa.int64()) for x in columns]
            return pa.RecordBatch.from_arrays([arrays[0], pa.array([uri] * len(arrays[0])), *arrays[1:]], ["record_id", "path", "frame_offset", "frame_bytes", "offset", "length"])

        for b in batches:
            for row in zip(*b.columns, strict=True):
                k, u, body, refers = (x.as_py() for x in row)
                bundle.add(k, record(k, u, body, refers))
                if bundle.size >= bundle_bytes:
                    yield close()
                    bundle = Bundle(frame_bytes)
        if bundle.index or bundle._open:
            yield close()

    return materialize(judged.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that ``index`` names, by their own seek tables; digests and lengths are checked. An empty
    index gives an empty result; a bundle that several index rows name is read once."""
    ship(index.sparkSession)
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def frames(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([{"path": uri, "at": a, "packed": p, "plain": q, "checksum": c} for a, p, q, c in seek_table(uri)], schema)

    def records(batches):
        for b in batches:
            for f in b.to_pylist():
                data = zstandard.ZstdDecompressor().decompress(files.read(f["path"], f["at"], f["packed"]), f["plain"])
                if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != f["checksum"]:
                    raise ValueError("a frame differs from its checksum")
                at, out = 0, []
                while at < len(data):
                    row, at = parse(data, at)
                    out.append(row if payloads else row | {"payload": None})
                yield pa.RecordBatch.from_pylist(out, kind)

    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("plain", pa.int64()), ("checksum", pa.int64())])
    kind = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    found = index.select("path").distinct().mapInArrow(frames, "path string, at long, packed long, plain long, checksum long")
    return found.repartition(n, "path", "at").mapInArrow(records, RECORD)


def lookup(index: DataFrame, wanted: DataFrame, key: str = "record_id") -> DataFrame:
    """The records of the ids in ``wanted``: only their frames are fetched, and records are cut out at their offsets. Null ids
    find nothing, repeated ones count once, an id with several records gives each of them. Empty tables give an empty result."""
    ship(index.sparkSession)
    kind = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def fetch(batches):
        for b in batches:
            last, data = None, b""
            out = []
            for r in b.to_pylist():
                if (r["path"], r["frame_offset"]) != last:
                    last = r["path"], r["frame_offset"]
                    data = zstandard.ZstdDecompressor().decompress(files.read(r["path"], r["frame_offset"], r["frame_bytes"]))
                out.append(parse(data[r["offset"] : r["offset"] + r["length"]])[0])
            yield pa.RecordBatch.from_pylist(out, kind)

    ids = wanted.select(F.col(f"`{key}`").alias("record_id")).distinct()
    hit = index.join(ids, "record_id", "left_semi").sortWithinPartitions("path", "frame_offset", "offset")
    return hit.mapInArrow(fetch, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written to archives, and what the archives say of each."""
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), shared_dir(spark, "warc"))
    out = read_bundles(index, payloads=False)
    return out.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS last FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM g
"""
