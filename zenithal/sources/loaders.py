"""Files of several formats as one table of documents: a registry of loaders, chosen by path and content.

A loader says by columns which files are its own, and turns rows (path, content binary) into (path, sections). The first
loader that knows a file takes it; each format is one branch of the plan, so a file is opened by one parser. Files come from Spark's
``binaryFile`` source, or, where a table names them, from tasks that open those of their rows, so that nothing lists millions of
files; what no loader knows, or its loader can't read, is a row with an error."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.session import shared_dir, ship
from zenithal.sources import documents


@dataclass(frozen=True)
class Loader:
    """``knows``: from (path, first bytes as Latin-1 text) whether a file is this loader's; ``load``: rows (path, content) to (path, sections)."""

    name: str
    knows: Callable[[Column, Column], Column]
    load: Callable[[DataFrame], DataFrame]


LOADERS: list[Loader] = []
#: Bytes of contents that a task gathers before it hands them on.
READ_BYTES = 1 << 24


def register(name: str, knows: Callable[[Column, Column], Column]) -> Callable:
    """Decorator: add a loader behind those that are there."""

    def add(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        LOADERS.append(Loader(name, knows, fn))
        return fn

    return add


@register("docx", lambda path, head: path.endswith(".docx") | head.startswith("PK\x03\x04"))
def _docx(files: DataFrame) -> DataFrame:
    return documents.load_docx(files)


@register("html", lambda path, head: path.rlike(r"\.html?$") | head.rlike(r"(?is)^\s*<(?:!doctype\s+html|html)\b"))
def _html(files: DataFrame) -> DataFrame:
    rows = documents.load_html(files.select("path", F.decode("content", "UTF-8").alias("html")), "path", "html")
    return rows.select(F.col("key").alias("path"), "sections")


@register("latex", lambda path, head: path.rlike(r"\.(?:tex|latex)$") | head.contains("\\documentclass"))
def _latex(files: DataFrame) -> DataFrame:
    raw = F.decode("content", "UTF-8")
    body = F.regexp_replace(F.regexp_replace(raw, r"(?s)^.*?\\begin\{document\}", ""), r"(?s)\\end\{document\}.*$", "")
    return files.select("path", F.array(F.struct(F.lit("Document").alias("heading"), documents.latex_text(body).alias("body"))).alias("sections"))


def load(files: DataFrame, loaders: list[Loader] | None = None) -> DataFrame:
    """(path, loader, sections, content, error) for each row of ``files`` (path, content). Null contents are errors.

    Contents are written once by loader, so a file is opened once and a loader's branch reads its own files only."""
    ship(files.sparkSession)
    path, head = F.lower("path"), F.decode(F.substring("content", 1, 512), "ISO-8859-1")
    chosen = F.lit(None).cast("string")
    loaders = LOADERS if loaders is None else loaders
    for x in reversed(loaders):
        chosen = F.when(F.coalesce(x.knows(path, head), F.lit(False)), x.name).otherwise(chosen)
    rows = files.select("path", "content", F.when(F.col("content").isNotNull(), chosen).alias("loader"))
    where = shared_dir(files.sparkSession, "files-by-loader")
    rows.write.partitionBy("loader").option("compression", "zstd").parquet(where)
    rows = files.sparkSession.read.schema(rows.schema).parquet(where)
    out = rows.where("loader is null").select("path", "loader", F.array().cast(documents.SECTIONS).alias("sections"), F.lit("no loader knows this file").alias("error"))
    for x in loaders:
        own = x.load(rows.where(F.col("loader") == x.name).select("path", "content"))
        error = F.when(F.size("sections") <= 0, F.lit("nothing could be read"))
        out = out.unionByName(own.select("path", F.lit(x.name).alias("loader"), "sections", error.alias("error")))
    content = F.array_join(F.transform("sections", lambda s: F.concat(s["heading"], F.lit("\n"), s["body"])), "\n\n")
    return out.select("path", "loader", "sections", content.alias("content"), "error")


def load_folder(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"))


def read_files(paths: DataFrame, path: str, folder: str) -> DataFrame:
    """(path, content) of the files of ``folder`` that rows of ``paths`` name; a file that isn't there is an error."""
    ship(paths.sparkSession)

    def run(batches):
        where, root = fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", folder))
        for b in batches:
            names, found, size = [], [], 0
            for name in b.column(0).to_pylist():
                with where.open_input_stream(f"{root}/{name}") as f:
                    found.append(f.read())
                names.append(name)
                size += len(found[-1])
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found, pa.binary())], ["path", "content"])
                    names, found, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found, pa.binary())], ["path", "content"])

    spark = paths.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return paths.select(F.col(path).alias("path")).repartition(n, "path").mapInArrow(run, "path string, content binary")


def _docx_bytes(text: str) -> bytes:
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{paragraphs}</w:body></w:document>')
    return sink.getvalue()


#: How a text is written in each format.
WRITERS: dict[str, Callable[[str], bytes]] = {
    "docx": _docx_bytes,
    "html": lambda text: f"<!DOCTYPE html><html><body><p>{escape(text)}</p></body></html>".encode(),
    "latex": lambda text: f"\\documentclass{{article}}\n\\begin{{document}}\n{text}\n\\end{{document}}\n".encode(),
}
#: What a format can't hold: control characters in XML, marks of commands and formulas in LaTeX.
REFUSED = {"docx": r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "latex": r"[\\{}$]"}


def export(docs: DataFrame, key: str, text: str, kind: Column, folder: str) -> DataFrame:
    """Write each text as a file of its ``kind`` (a column: docx, html, latex); returns (key, kind, name), with names as in
    the folder, which deals files to 256 folders. Names tell nothing of the format, so a reader must look at the content. Files of attempts that failed are in no row."""
    ship(docs.sparkSession)
    names = docs.schema[key].dataType.simpleString()

    def write(batches):
        where, root = fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", folder))
        for k in range(256):
            where.create_dir(f"{root}/{k:02x}", recursive=True)
        for b in batches:
            paths = []
            for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                paths.append(f"{(name := uuid.uuid4().hex)[:2]}/{name}.bin")
                with where.open_output_stream(f"{root}/{paths[-1]}") as f:
                    f.write(WRITERS[k](t or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(paths)], ["key", "kind", "name"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), kind.alias("kind")).mapInArrow(write, f"key {names}, kind string, name string")
