"""Tables in chunks of time: partitioned writes, changes that rewrite only their chunks, compaction, retention by whole chunks.

A chunk is a folder of ``days`` days, numbered from 1970. Rows of new chunks are appended; a change rewrites the chunks that it
touches and no other (dynamic partition overwrite). Old chunks are compacted: few files, sorted by time, packed harder. Retention
deletes folders of chunks that lie wholly before the limit, so no row is read for it. A read with a range of times is pruned
to its chunks. Writers of the same chunk must not run at the same time; a change is not atomic over several chunks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.session import discard, materialize


def _days(t: Column) -> Column:
    return F.date_diff(F.to_date(t), F.lit("1970-01-01").cast("date"))


def _day(at: datetime.datetime) -> int:
    return (at.date() - datetime.date(1970, 1, 1)).days


class TimeChunks:
    """A table of chunks at ``path`` by the column ``time``; rows without a time have no chunk and are refused."""

    def __init__(self, spark: SparkSession, path: str, time: str, days: int):
        self.spark, self.path, self.time, self.days = spark, path, time, days

    def _chunked(self, rows: DataFrame) -> DataFrame:
        number = F.floor(_days(F.col(self.time)) / self.days).cast("int")
        return rows.withColumn("chunk", F.when(F.col(self.time).isNull(), F.raise_error(F.lit(f"a row without {self.time} has no chunk")).cast("int")).otherwise(number))

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Spark evens out parts by chunk: no chunk has more files than its size asks for, and a very large one is several."""
        out = rows.hint("rebalance", "chunk").sortWithinPartitions("chunk", self.time)
        out.write.mode(mode).partitionBy("chunk").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._write(self._chunked(rows), "append")

    def read(self, start: datetime.datetime | None = None, end: datetime.datetime | None = None) -> DataFrame:
        """Rows with start <= time < end; only their chunks are listed and read."""
        rows = self.spark.read.parquet(self.path)
        if start is not None:
            rows = rows.where((F.col("chunk") >= _day(start) // self.days) & (F.col(self.time) >= F.lit(start).cast(rows.schema[self.time].dataType)))
        if end is not None:
            rows = rows.where((F.col("chunk") <= _day(end) // self.days) & (F.col(self.time) < F.lit(end).cast(rows.schema[self.time].dataType)))
        return rows

    def upsert(self, changes: DataFrame, keys: list[str]) -> list[int]:
        """Rows of ``changes`` (distinct by ``keys`` and time) replace those of the same keys in their chunk, or are added. Returns the chunks that were rewritten."""
        new = materialize(self._chunked(changes), "chunk-changes")
        touched = sorted(r.chunk for r in new.select("chunk").distinct().collect())  # numbers of chunks only
        there = {c["chunk"] for c in self.chunks()}
        old = self.spark.read.parquet(self.path).where(F.col("chunk").isin([c for c in touched if c in there])) if there else None
        merged = new if old is None else old.join(new.select("chunk", *keys), ["chunk", *keys], "left_anti").unionByName(new)
        staged = materialize(merged, "chunk-merged")  # the chunks that are read are those that are written
        self._write(staged, "overwrite")
        discard(staged)
        discard(new)
        return touched

    def chunks(self) -> list[dict]:
        """Each chunk with its number of files and bytes, from the listing alone."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(hadoop)
        if not fs.exists(root):
            return []
        out = []
        for d in fs.listStatus(root):
            if d.isDirectory() and d.getPath().getName().startswith("chunk="):
                parts = [f for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
                out.append({"chunk": int(d.getPath().getName()[6:]), "files": len(parts), "bytes": sum(f.getLen() for f in parts)})
        return sorted(out, key=lambda c: c["chunk"])

    def compact(self, before: datetime.datetime, file_bytes: int = 128 << 20) -> list[int]:
        """Rewrite chunks that end at ``before`` or earlier and have more files than their bytes ask for. Returns their numbers."""
        due = [c["chunk"] for c in self.chunks() if (c["chunk"] + 1) * self.days <= _day(before) and c["files"] > max(1, -(-c["bytes"] // file_bytes))]
        if due:
            staged = materialize(self.spark.read.parquet(self.path).where(F.col("chunk").isin(due)), "chunk-compact")
            self._write(staged, "overwrite")
            discard(staged)
        return due

    def retain(self, after: datetime.datetime) -> list[int]:
        """Delete chunks that end at ``after`` or earlier; a chunk that holds one later moment stays whole. Returns their numbers."""
        gone = [c["chunk"] for c in self.chunks() if (c["chunk"] + 1) * self.days <= _day(after)]
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for c in gone:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/chunk={c}")
            p.getFileSystem(hadoop).delete(p, True)
        return gone
