"""Exact duplicates by counting quotient filters.

A filter holds a multiset of fingerprints without loss. A fingerprint's upper bits are its quotient, the rest its remainder.
Remainders lie sorted by (quotient, remainder); a bit for each quotient says whether it has a run, a bit for each remainder
whether it ends one, so a remainder's quotient is never stored; remainders that are there more than once have a counter.

Every task builds the filters of its own rows, one for each shard (a range of the leading bits), so an often repeated text is
one remainder with a count. Filters of a shard merge by their sorted remainders, counts added: the merged filter is the one that
all rows together would have built. The number of shards follows the number of rows, so a merged filter stays small.

Fingerprints with a count above one go on to the comparison of bytes. Which rows those are, a map of fixed size tells (a bit
for each value of a fingerprint's ``MAP_BITS`` leading bits): a row whose bit is not set is alone and its text is never moved. A
set bit may be another fingerprint's, which costs a comparison and changes nothing. Texts with set bits are grouped by all of
their bytes; copies are combined in each task before the shuffle.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.llm.skew import join_counted
from zenithal.session import materialize, ship

#: Bits of a fingerprint, rows of a shard, and leading bits in the map that is broadcast (2 MB at any size of the input).
BITS, SHARD_ROWS, MAP_BITS = 64, 1 << 16, 24
_HEAD = struct.Struct("<BBQQ")


@dataclass
class QuotientFilter:
    """Fingerprints of ``bits`` bits, of which ``q`` are the quotient, sorted by (quotient, remainder)."""

    bits: int
    q: int
    occupied: np.ndarray  # for each quotient: has a run
    ends: np.ndarray  # for each remainder: ends its run
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = 48, q: int | None = None) -> QuotientFilter:
        """Of any fingerprints (unsigned, below 2**bits), repeated ones included; ``counts``: how often each stands for itself."""
        v = fingerprints.astype(np.uint64)
        n = np.ones(len(v), np.uint64) if counts is None else counts.astype(np.uint64)
        by = np.argsort(v, kind="stable")
        v, n = v[by], n[by]
        first = np.nonzero(np.concatenate([np.ones(min(1, len(v)), bool), v[1:] != v[:-1]]))[0]
        n = np.add.reduceat(n, first) if len(v) else n
        v = v[first]
        if q is None:
            q = min(bits, max(1, int(len(v)).bit_length()))
        rest = np.uint64(bits - q)
        quotients = (v >> rest).astype(np.int64) if bits > q else v.astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        ends = np.concatenate([quotients[1:] != quotients[:-1], np.ones(min(1, len(v)), bool)])
        return cls(bits, q, occupied, ends, v & np.uint64((1 << int(rest)) - 1), n)

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all their fingerprints together: sorted remainders merge, counts add up."""
        bits = filters[0].bits
        parts = [f.items() for f in filters]
        return cls.build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in ascending order, counts): each run's quotient is the next occupied one."""
        run = np.cumsum(np.concatenate([np.zeros(min(1, len(self.ends)), np.int64), self.ends[:-1].astype(np.int64)]))
        quotients = np.nonzero(self.occupied)[0].astype(np.uint64)[run] if len(run) else np.zeros(0, np.uint64)
        high = quotients << np.uint64(self.bits - self.q) if self.bits > self.q else quotients
        return high | self.remainders, self.counts

    def count(self, fingerprint: int) -> int:
        """How often it is there: rank of its quotient among the occupied, then a search in that run."""
        quotient, remainder = fingerprint >> (self.bits - self.q), fingerprint & ((1 << (self.bits - self.q)) - 1)
        if not self.occupied[quotient]:
            return 0
        run, stops = int(self.occupied[:quotient].sum()), np.nonzero(self.ends)[0]
        a, b = (int(stops[run - 1]) + 1 if run else 0), int(stops[run]) + 1
        at = a + int(np.searchsorted(self.remainders[a:b], np.uint64(remainder)))
        return int(self.counts[at]) if at < b and int(self.remainders[at]) == remainder else 0

    def to_bytes(self) -> bytes:
        width = (self.bits - self.q + 7) // 8
        more = self.counts > 1
        body = np.ascontiguousarray(self.remainders.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.ends, more)]
        return b"".join([_HEAD.pack(self.bits, self.q, len(self.remainders), int(more.sum())), *bits, body.tobytes(), self.counts[more].astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        bits, q, n, repeated = _HEAD.unpack_from(data)
        raw, at, width = np.frombuffer(data, np.uint8), _HEAD.size, (bits - q + 7) // 8
        flags = []
        for size in (1 << q, n, n):
            flags.append(np.unpackbits(raw[at : at + (size + 7) // 8], count=size).astype(bool))
            at += (size + 7) // 8
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = raw[at : at + n * width].reshape(n, width)
        counts = np.ones(n, np.uint64)
        counts[flags[2]] = np.frombuffer(data, "<u8", repeated, at + n * width)
        return cls(bits, q, flags[0], flags[1], rest.reshape(-1).view("<u8"), counts)


def _build(bits: int, shard_bits: int):
    """Rows (fingerprint) to (shard, filter): the filters of a task, folded whenever it has read a million rows more."""

    def filters(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        v, n = np.concatenate(held), np.concatenate(counts)
        v, at = np.unique(v, return_inverse=True)
        return [v], [np.bincount(at, n.astype(np.float64), len(v)).astype(np.uint64)]  # below 2**53 rows in a task

    def run(batches):
        held, counts, fresh = [], [], 0
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            held.append(v)
            counts.append(np.ones(len(v), np.uint64))
            fresh += len(v)
            if fresh >= 1 << 20:
                held, counts = filters(held, counts)
                fresh = 0
        if not held:
            return
        (v,), (n,) = filters(held, counts)
        own = np.uint64(bits - shard_bits)
        starts = np.searchsorted(v, np.arange(1 << shard_bits, dtype=np.uint64) << own)
        for shard, (a, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(v)], strict=True)):
            if e > a:
                f = QuotientFilter.build(v[a:e] & np.uint64((1 << int(own)) - 1), n[a:e], int(own))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f.to_bytes()], pa.binary())], ["shard", "filter"])

    return run


def _merge(batches):
    """Filters sorted by shard to one filter for each shard; a few are held at a time."""
    shard, held, size = None, [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([QuotientFilter.merge(held).to_bytes()], pa.binary())], ["shard", "filter"])

    for b in batches:
        for s, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if s != shard:
                if held:
                    yield out()
                shard, held, size = s, [], 0
            held.append(QuotientFilter.from_bytes(data.as_py()))
            size += len(held[-1].remainders)
            if size > 1 << 21 and len(held) > 1:
                held = [QuotientFilter.merge(held)]
                size = 0
    if held:
        yield out()


def build_filters(fingerprints: DataFrame, bits: int = BITS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(shard, filter) merged over all rows of a written table with one column of 64-bit fingerprints (their ``bits`` leading
    ones count), and the number of leading bits that are the shard. Empty shards have no row; neither has an empty table."""
    ship(fingerprints.sparkSession)
    rows = fingerprints.count()
    shard_bits = min(bits - 1, max(7, (rows // shard_rows).bit_length()))
    own = fingerprints.mapInArrow(_build(bits, shard_bits), "shard int, filter binary")
    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = own.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_merge, "shard int, filter binary")
    return materialize(merged, "quotient-filters"), shard_bits


def counts_of(filters: DataFrame, bits: int, shard_bits: int, least: int = 1) -> DataFrame:
    """(fingerprint, n): the fingerprints of merged filters that are there ``least`` times or more, as signed longs of which
    ``bits`` leading bits are theirs."""

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v, n = QuotientFilter.from_bytes(data.as_py()).items()
                v, n = v[n >= least], n[n >= least]
                whole = ((np.uint64(shard) << np.uint64(bits - shard_bits)) | v) << np.uint64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64))], ["fingerprint", "n"])

    return filters.mapInArrow(run, "fingerprint long, n long")


def repeated_map(repeated: DataFrame, map_bits: int) -> bytes:
    """A map with a bit for each value of the ``map_bits`` leading bits that a fingerprint of ``repeated`` has."""
    low = max(0, map_bits - 13)  # a piece of 8,192 bits is a row, so at most 2**(map_bits - 13) rows of 1 KB come to the driver

    def pieces(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            top = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - map_bits)
            piece, bit = (top >> np.uint64(map_bits - low)).astype(np.int64), (top & np.uint64((1 << (map_bits - low)) - 1)).astype(np.int64)
            for p in np.unique(piece).tolist():
                held.setdefault(p, np.zeros(1 << (map_bits - low), np.uint8))[bit[piece == p]] = 1
        for p, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary())], ["piece", "bits"])

    n = int(repeated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = repeated.select("fingerprint", (F.shiftrightunsigned("fingerprint", 64 - low) if low else F.lit(0)).alias("piece")).repartition(n, "piece")
    whole = np.zeros((1 << low, max(1, (1 << (map_bits - low)) // 8)), np.uint8)
    for r in dealt.select("fingerprint").mapInArrow(pieces, "piece long, bits binary").collect():
        whole[r.piece] |= np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return whole.tobytes()


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _routed(rows: DataFrame, found: bytes, map_bits: int) -> DataFrame:
    """The rows (text, key, fingerprint) whose bit is set in the map."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        flags = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            top = (b.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - map_bits)).astype(np.int64)
            hit = flags[top >> 3] >> (7 - (top & 7)).astype(np.uint8) & 1
            if hit.any():
                yield b.filter(pa.array(hit.astype(bool)))

    return rows.mapInArrow(run, rows.schema)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, map_bits: int = MAP_BITS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for each row: texts are equal if they are the same bytes after each run of
    ASCII blanks is one space; of equal ones the row with the smallest key stays.

    Null texts are empty ones. Null keys come after all others; of rows that share text and key one stays. Texts are read
    and compared whole. An empty table gives an empty result. Other columns are not read, whatever their names.
    ``bits``: of the fingerprint; ``map_bits``: of the map (fewer bits: more comparisons, equal results).
    """
    ship(docs.sparkSession)
    rows = docs.select(normalised(F.col(f"`{text}`")).alias("text"), F.col(f"`{key}`").alias("key"))
    rows = rows.select("text", "key", F.xxhash64("text").alias("fingerprint"))
    marks = materialize(rows.select("key", "fingerprint", F.sha2("text", 256).alias("text_sha256")), "exact-marks")
    filters, shard_bits = build_filters(marks.select("fingerprint"), bits)
    found = repeated_map(counts_of(filters, bits, shard_bits, least=2), min(map_bits, bits))
    groups = _routed(rows, found, min(map_bits, bits)).groupBy("text").agg(F.min("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size", F.col("group_size").alias("copies"))
    groups = materialize(groups, "exact-groups")
    met = materialize(join_counted(marks.select("key", "text_sha256"), groups, "text_sha256", "copies", how="left"), "exact-met")
    alone = met.where("group_size is null").select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    same = F.col("key").eqNullSafe(F.col("keep_id"))
    others = met.where("group_size is not null").where(~same).select("key", "keep_id", "group_size", F.lit(False).alias("kept"), "text_sha256")
    first = met.where("group_size is not null").where(same).groupBy("key", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("key", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"), "text_sha256").select("key", "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "text_sha256")
    return alone.unionByName(others).unionByName(first).withColumnRenamed("key", key)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the one that stays for it."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM d"""
