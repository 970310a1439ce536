"""Token files in patched frame-of-reference blocks.

A file holds the ids of consecutive documents without gaps, in blocks of 1024 ids (the last may be shorter):

    magic 4 bytes | blocks | starts of the blocks (n + 1 of u64) | documents: key i64, has-key u8, ids u32 | u64 blocks, u64 documents, u64 ids, magic

    block: least id u32 | count u16 | width u8 | exceptions u16 | packed (id - least) of ``width`` bits, zero for exceptions
           | positions u16 of the exceptions | their (id - least) u32

The width is that of the ``percentile``-th difference, so a few large ids don't widen a block: they are its exceptions. The
starts give random access: ids a..b need only blocks a // 1024 to b // 1024.

Documents are dealt by ranges of their key and sorted, so files in order of (part, number) hold all documents in order; the
start of each file is a running sum over the manifest of files.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.llm import files, tokens
from zenithal.session import materialize, shared_dir, ship

MAGIC, BLOCK, HEAD = b"PFR1", 1024, struct.Struct("<IHBH")


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes."""
    if not width:
        return np.zeros((len(v), 0), np.uint8)
    kind = 16 if width <= 16 else 32
    if width == kind:  # whole bytes
        return v.astype(f">u{kind // 8}").view(np.uint8)
    bits = np.unpackbits(v.astype(f">u{kind // 8}").view(np.uint8).reshape(-1, kind // 8), axis=1)[:, kind - width :]
    return np.packbits(bits.reshape(len(v), -1), axis=1)


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    """The reverse of :func:`_pack` for rows of bytes."""
    if not width:
        return np.zeros((len(data), count), np.uint32)
    kind = 16 if width <= 16 else 32
    if width == kind:
        return np.ascontiguousarray(data).view(f">u{kind // 8}").astype(np.uint32)
    bits = np.zeros((len(data) * count, kind), np.uint8)
    bits[:, kind - width :] = np.unpackbits(data, axis=1)[:, : count * width].reshape(-1, width)
    return np.packbits(bits, axis=1).view(f">u{kind // 8}").reshape(len(data), count).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: float = 0.98) -> list[bytes]:
    """Blocks of ``ids``; blocks of one width are packed together."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK
    for v in (ids[: whole * BLOCK].reshape(whole, BLOCK), ids[whole * BLOCK :].reshape(1, -1)):
        if not v.size:
            continue
        count = v.shape[1]
        least = v.min(axis=1)
        v = v - least[:, None]
        at = min(count - 1, int(percentile * count))
        widths = np.array([int(x).bit_length() for x in np.partition(v, at, axis=1)[:, at]])
        done: list[bytes] = [b""] * len(v)
        for width in np.unique(widths):
            rows = np.nonzero(widths == width)[0]
            own = v[rows]
            over = own >> np.uint32(width) > 0 if width < 32 else np.zeros(own.shape, bool)
            packed = _pack(np.where(over, 0, own), int(width))
            for k, row in enumerate(rows.tolist()):
                where = np.nonzero(over[k])[0]
                done[row] = HEAD.pack(int(least[row]), count, int(width), len(where)) + packed[k].tobytes() + where.astype("<u2").tobytes() + own[k][where].astype("<u4").tobytes()
        out += done
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that lie at ``starts`` (one more: the end) in ``data``."""
    heads = [HEAD.unpack_from(data, s) for s in starts[:-1].tolist()]
    raw, out = np.frombuffer(data, np.uint8), [np.zeros(0, np.uint32)] * len(heads)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, count, width, _) in enumerate(heads):
        groups.setdefault((count, width), []).append(i)
    for (count, width), rows in groups.items():
        size = (count * width + 7) // 8
        at = starts[rows] + HEAD.size
        v = _unpack(raw[at[:, None] + np.arange(size)[None]], count, width)
        for k, i in enumerate(rows):
            least, _, _, n = heads[i]
            if n:
                a = int(at[k]) + size
                v[k, np.frombuffer(data, "<u2", n, a)] = np.frombuffer(data, "<u4", n, a + 2 * n)
            out[i] = v[k] + np.uint32(least)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pack_file(ids: np.ndarray, keys: list[int | None], sizes: list[int]) -> bytes:
    blocks = encode_blocks(ids)
    starts = np.cumsum([len(MAGIC), *map(len, blocks)]).astype("<u8")
    return b"".join([
        MAGIC, *blocks, starts.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is not None for k in keys),
        np.array(sizes, "<u4").tobytes(), struct.pack("<QQQ", len(blocks), len(keys), len(ids)), MAGIC,
    ])


def unpack_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, keys, ids of each document) of a whole file."""
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a token file")
    n_blocks, n_docs, n_ids = struct.unpack("<QQQ", data[-28:-4])
    at = len(data) - 28 - 13 * n_docs
    keys = np.frombuffer(data, "<i8", n_docs, at).tolist()
    has = data[at + 8 * n_docs : at + 9 * n_docs]
    sizes = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs)
    ids = decode_blocks(data, np.frombuffer(data, "<u8", n_blocks + 1, at - 8 * (n_blocks + 1)).astype(np.int64))
    if len(ids) != n_ids or sizes.sum() != n_ids:
        raise ValueError("token file is damaged")
    return ids, [k if h else None for k, h in zip(keys, has, strict=True)], sizes


def read_ids(uri: str, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first`` of a file, by its block index; reads only the blocks that hold them."""
    n_blocks, n_docs, n_ids = struct.unpack("<QQQ", files.tail(uri, 28)[:-4])
    if first < 0 or count < 0 or first + count > n_ids:
        raise IndexError("ids beyond the file")
    if not count:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, (first + count - 1) // BLOCK
    foot = 28 + 13 * n_docs + 8 * (n_blocks + 1)
    index = np.frombuffer(files.tail(uri, foot)[: 8 * (n_blocks + 1)], "<u8")[a : b + 2].astype(np.int64)
    ids = decode_blocks(files.read(uri, int(index[0]), int(index[-1] - index[0])), index - index[0])
    return ids[first - a * BLOCK :][:count]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end: int = 0, file_ids: int = 1 << 21) -> DataFrame:
    """Write the ids of every whole text, each followed by ``end``, to files in ``folder``, in ascending order of ``key``.

    Returns the manifest (part, number, path, n_docs, n_tokens, start). Null texts are empty; null keys come first; rows
    with the same key stand by a hash of their text. ``file_ids``: a file is closed at the first document that reaches it.
    Files of attempts that failed aren't in the manifest. Longer texts than a file are one file. An empty table gives an
    empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stop = np.array([end], "<u4").tobytes()

    def write(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, keys, sizes, total = [], [], [], 0
        encode = tokens.cache(tokenizer).encode

        def close():
            uri = f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.pfor"
            files.write(uri, pack_file(np.frombuffer(b"".join(held), "<u4"), keys, sizes))
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": uri, "n_docs": len(keys), "n_tokens": total}], schema)

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(t.as_py() or "") + stop
                held.append(ids)
                keys.append(k)
                sizes.append(len(ids) // 4)
                total += sizes[-1]
                if total >= file_ids:
                    yield close()
                    held, keys, sizes, total, number = [], [], [], 0, number + 1
        if keys:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h").select("key", "text")
    manifest = materialize(dealt.mapInArrow(write, "part int, number int, path string, n_docs long, n_tokens long"), "pfor-manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = F.coalesce(F.sum("own").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = manifest.join(parts.select("part", before.alias("before")), "part")
    return out.select("part", "number", "path", "n_docs", "n_tokens", (F.col("before") + inside).alias("start"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files of a manifest."""
    ship(manifest.sparkSession)

    def read(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, keys, sizes = unpack_file(files.read(uri))
                ends = np.cumsum(sizes.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every text of ``documents`` written as ids and read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = read_tokens(write_tokens(docs, tokenizer, shared_dir(spark, "tokens")))
    return out.withColumnRenamed("key", "doc_id")
