"""A journal of committed segments as a Spark data source: ``spark.read/readStream/write/writeStream.format("journal")``.

A journal is a folder. ``data`` holds segments (Arrow files, one for each task that wrote), ``log`` a numbered entry for each
commit with the segments it adds and the least and greatest value of their columns. An entry is put in place whole and its
number can be taken once, so a reader sees a commit or nothing of it.

* Writes: tasks write segments, the driver commits them with one entry, or deletes them if the job is aborted. Segments of
  attempts that failed are in no entry. A streamed micro-batch that is already in the log is not committed again.
* Reads: a partition for each segment. Comparisons that are pushed down (see :func:`read`) drop segments by their least and greatest
  values, and rows in Arrow, before Spark sees them.
* Streams: an offset is a number of the log, so a restarted query goes on with the entry after the last that it committed.
"""

from __future__ import annotations

import datetime
import decimal
import json
import operator
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from zenithal.session import ship

PUSHDOWN, SEGMENT = "spark.sql.python.filterPushdown.enabled", "_segment"
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_IN_ARROW = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
#: Types whose least and greatest values are noted, and compared as they come from Spark.
_ORDERED = (int, float, str, datetime.date, datetime.datetime, decimal.Decimal)


def add_journal(spark: SparkSession) -> None:
    """Make the format known."""
    ship(spark)
    spark.conf.set(PUSHDOWN, "true")  # only readers made by :func:`read` take filters
    spark.dataSource.register(Journal)


def read(spark: SparkSession, path: str, condition: str | Column) -> DataFrame:
    """The rows of a journal that meet a condition, whose comparisons are pushed down to the source.

    Spark 4.1 keeps what was pushed down with a relation, and uses it for a later query over it that has nothing to push, which
    would lose rows. So this makes a relation of its own, which has a column that every query over it asks for: there
    always is something to push."""
    rows = spark.read.format("journal").option("pushdown", "true").load(path)
    return rows.where(condition).where(F.col(SEGMENT).isNotNull()).drop(SEGMENT)


class Folder:
    """The files of a journal, on any file system that Arrow knows."""

    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", uri) if "://" in uri or uri.startswith("file:") else uri)

    def entries(self, after: int = 0) -> list[dict]:
        """The commits behind number ``after``, in order."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        names = sorted(f.path for f in found if f.path.endswith(".json") and int(f.base_name[:-5]) > after)
        return [json.loads(self.read(n)) for n in names]

    def last(self) -> int:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        return max([0, *(int(f.base_name[:-5]) for f in found if f.path.endswith(".json"))])

    def read(self, path: str) -> bytes:
        with self.fs.open_input_file(path) as f:
            return f.read()

    def put(self, path: str, data: bytes) -> None:
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(path) as f:
            f.write(data)

    def commit(self, entry: dict) -> int:
        """Append an entry. One driver writes a journal at a time; it takes the next number."""
        number = self.last() + 1
        path = f"{self.root}/log/{number:012d}.json"
        self.put(f"{path}.{uuid.uuid4().hex}", json.dumps(entry | {"number": number}).encode())
        (held,) = [f.path for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/log")) if f.path.startswith(f"{path}.")][:1]
        self.fs.move(held, path)
        return number

    def delete(self, paths: Iterable[str]) -> None:
        for p in paths:
            self.fs.delete_file(p)


def _plain(v):
    return v.isoformat() if isinstance(v, datetime.date) else str(v) if isinstance(v, decimal.Decimal) else v


def _bounds(table: pa.Table) -> dict[str, list]:
    """The least and greatest value of each column that has an order and values, as JSON can hold them."""
    out = {}
    for name, column in zip(table.column_names, table.columns, strict=True):
        if column.null_count < len(column) and not pa.types.is_nested(column.type) and not pa.types.is_boolean(column.type) and not pa.types.is_binary(column.type):
            if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
                continue
            low, high = pc.min_max(column).as_py().values()
            if isinstance(low, _ORDERED):
                out[name] = [_plain(low), _plain(high)]
    return out


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int
    bounds: dict


@dataclass
class Segment(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class Journal(DataSource):
    """Options: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        entries = Folder(self.options["path"]).entries()
        if not entries:
            raise ValueError("an empty journal has no columns; give a schema")
        return entries[-1]["schema"] + (f", {SEGMENT} string" if self.options.get("pushdown") == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_Filtered if self.options.get("pushdown") == "true" else _Reader)(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return _StreamWriter(self.options["path"], schema)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _rows(uri: str, path: str, names: list[str], filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    folder = Folder(uri)
    with pa.ipc.open_file(folder.fs.open_input_file(path)) as f:
        for i in range(f.num_record_batches):
            b = f.get_batch(i)
            if SEGMENT in names:
                b = b.append_column(SEGMENT, pa.array([path] * b.num_rows, pa.string()))
            for x in filters:
                (name,) = x.attribute
                column = b.column(b.schema.get_field_index(name))
                if isinstance(x, IsNotNull):
                    keep = column.is_valid()
                elif isinstance(x, In):
                    keep = pc.is_in(column, value_set=pa.array([v for v in x.value if v is not None], column.type))
                else:
                    keep = _IN_ARROW[type(x)](column, pa.scalar(x.value, column.type))
                b = b.filter(keep)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names], names)


class _Reader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType):
        self.uri, self.names, self.filters, self.kinds = uri, schema.names, [], {f.name: f.dataType.simpleString() for f in schema.fields}

    def _may_hold(self, bounds: dict[str, list]) -> bool:
        for x in self.filters:
            low, high = bounds.get(x.attribute[0], [None, None])
            if low is None or isinstance(x, IsNotNull) or self.kinds[x.attribute[0]].startswith("decimal"):  # kept as text, which has another order
                continue
            value = [_plain(v) for v in x.value if v is not None] if isinstance(x, In) else _plain(x.value)
            if isinstance(x, In):
                if not any(low <= v <= high for v in value):
                    return False
            elif isinstance(x, EqualTo) and not low <= value <= high or isinstance(x, (GreaterThan, GreaterThanOrEqual)) and not _COMPARE[type(x)](high, value) or isinstance(x, (LessThan, LessThanOrEqual)) and not _COMPARE[type(x)](low, value):
                return False
        return True

    def partitions(self) -> list[Segment]:
        held: list[dict] = []
        for e in Folder(self.uri).entries():
            held = [*([] if e["overwrite"] else held), *e["segments"]]
        return [Segment(s["path"]) for s in held if self._may_hold(s["bounds"])]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _rows(self.uri, partition.path, self.names, self.filters)


class _Filtered(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of whole columns with values are done here; all others stay with Spark."""
        for x in filters:
            known = isinstance(x, (*_COMPARE, In, IsNotNull)) and len(x.attribute) == 1
            if known and not isinstance(x, IsNotNull):
                values = x.value if isinstance(x, In) else [x.value]
                # Zoned times and NaN compare in other ways in Arrow; they stay with Spark.
                known = all(v is None or isinstance(v, _ORDERED) and v == v for v in values) and self.kinds.get(x.attribute[0]) not in ("timestamp", "double", "float", "boolean") and not (x.__class__ in _COMPARE and x.value is None)
            if known:
                self.filters.append(x)
            else:
                yield x


class _Stream(DataSourceStreamReader):
    """New rows of a journal that grows; an entry that overwrites ends the stream with an error."""

    def __init__(self, uri: str, schema: StructType):
        self.uri, self.names = uri, schema.names

    def initialOffset(self) -> dict:  # noqa: N802
        return {"number": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"number": Folder(self.uri).last()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        entries = [e for e in Folder(self.uri).entries(start["number"]) if e["number"] <= end["number"]]
        if any(e["overwrite"] and e["number"] > 1 for e in entries):
            raise ValueError("the journal was overwritten while it was streamed")
        return [Segment(s["path"]) for e in entries for s in e["segments"]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.uri, partition.path, self.names, [])

    def commit(self, end: dict) -> None:
        """Nothing is thrown away; the query's own checkpoint has the offset."""


class _Segments:
    def __init__(self, uri: str, schema: StructType, overwrite: bool = False):
        self.uri, self.ddl, self.overwrite = uri, _ddl(schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One segment for a task; none for a task without rows."""
        folder = Folder(self.uri)
        path, writer, rows, bounds = f"{folder.root}/data/{uuid.uuid4().hex}.arrow", None, 0, []
        for b in iterator:
            if b.num_rows:
                if writer is None:
                    folder.fs.create_dir(f"{folder.root}/data", recursive=True)
                    sink = folder.fs.open_output_stream(path)
                    writer = pa.ipc.new_file(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(b)
                rows += b.num_rows
                bounds.append(_bounds(pa.Table.from_batches([b])))
        if writer is not None:
            writer.close()
            sink.close()
        names = set.intersection(*map(set, bounds)) if bounds else set()
        return Written(path if rows else "", rows, {n: [min(x[n][0] for x in bounds), max(x[n][1] for x in bounds)] for n in names})

    def _entry(self, messages: list[Written | None], **more) -> dict:
        return {"schema": self.ddl, "overwrite": self.overwrite, "segments": [{"path": m.path, "rows": m.rows, "bounds": m.bounds} for m in messages if m is not None and m.path]} | more

    def _undo(self, messages: list[Written | None]) -> None:
        Folder(self.uri).delete(m.path for m in messages if m is not None and m.path)


class _Writer(_Segments, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        Folder(self.uri).commit(self._entry(messages))

    def abort(self, messages: list[Written | None]) -> None:
        self._undo(messages)


class _StreamWriter(_Segments, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        folder = Folder(self.uri)
        if any(e.get("batch") == batchId for e in folder.entries()):
            self._undo(messages)
        else:
            folder.commit(self._entry(messages, batch=batchId))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._undo(messages)
