"""Documents from markup: HTML, LaTeX, DOCX, and the choice of a loader by path."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.session import by_slices, ship

SECTIONS = "array<struct<heading:string,body:string>>"
_SKIP, _HEADS, _BLOCKS = {"script", "style", "nav", "footer", "header", "aside"}, {"h1", "h2", "h3", "h4"}, {"p", "li", "pre"}


class _Sections(HTMLParser):
    """Headings open sections; paragraphs, list items and code of over 20 characters are their bodies."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections, self.heading, self.body, self.skip, self.tag, self.parts = [], "Introduction", [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip.append(tag)
        elif not self.skip and tag in _HEADS | _BLOCKS:
            self.close_block()
            self.tag = tag

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
        elif tag == self.tag:
            self.close_block()

    def handle_data(self, data):
        if self.tag and not self.skip and data.strip():
            self.parts.append(data.strip())

    def close_block(self):
        if self.tag in _HEADS:
            self.close_section()
            self.heading = "".join(self.parts)
        elif self.tag and len(text := " ".join(self.parts)) > 20:
            self.body.append(text)
        self.tag, self.parts = None, []

    def close_section(self):
        if self.body:
            self.sections.append({"heading": self.heading, "body": " ".join(self.body)})
        self.body = []


def html_sections(html: str | None) -> list[dict]:
    parser = _Sections()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    parser.close_section()
    return parser.sections


def load_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, sections, content, hash) of each page; a null page has no sections and an empty content."""
    ship(pages.sparkSession)
    inner = pa.list_(pa.struct([("heading", pa.string()), ("body", pa.string())]))

    @F.arrow_udf(SECTIONS)
    def sections(column: pa.Array) -> pa.Array:
        return by_slices(lambda own: [html_sections(x) for x in own], inner, column)

    # Marked so that Spark doesn't parse each page again for a filter on its sections.
    rows = pages.select(F.col(key).alias("key"), sections.asNondeterministic()(F.col(html)).alias("sections"))
    content = F.array_join(F.transform("sections", lambda s: F.concat(s["heading"], F.lit("\n"), s["body"])), "\n\n")
    return rows.withColumn("content", content).withColumn("hash", F.sha2("content", 256))


def html_text(html: Column) -> Column:
    """The text between tags, without scripts and styles, blanks folded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def latex_text(raw: Column) -> Column:
    """Readable text of LaTeX: formulas marked, commands and braces gone, at most one blank line in a row."""
    steps = [
        (r"(?s)\\begin\{equation\}(.*?)\\end\{equation\}", "\n[EQ] $1 [/EQ]\n"), (r"(?s)\$\$(.+?)\$\$", " [EQ] $1 [/EQ] "), (r"\$(.+?)\$", " $1 "), (r"\\[a-zA-Z]+\{([^}]*)\}", "$1"),
        (r"\\[a-zA-Z]+", ""), (r"[{}]", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
    ]
    for pattern, to in steps:
        raw = F.regexp_replace(raw, pattern, to)
    return raw


def latex_headings(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(r"\\(?:chapter|section|subsection|subsubsection)\*?\{([^}]+)\}"), F.lit(1))


def docx_sections(data: bytes) -> list[dict]:
    """Sections of a DOCX file by its heading styles, then its tables: each a section ``[TABLE]`` of rows of cells with bars
    between them."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    out, tables, heading, lines = [], [], "Document", []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    for e in body if body is not None else []:
        style = e.find(f"{w}pPr/{w}pStyle")
        if e.tag == f"{w}tbl":
            rows = "\n".join(" | ".join(text(c) for c in r.iter(f"{w}tc")) for r in e.iter(f"{w}tr"))
            tables += [{"heading": "[TABLE]", "body": rows}] if rows.strip() else []
        elif style is not None and re.match("Heading", style.get(f"{w}val", "")):
            out += [{"heading": heading, "body": " ".join(lines)}] if lines else []
            heading, lines = text(e), []
        elif text(e):
            lines.append(text(e))
    return [*out, *([{"heading": heading, "body": " ".join(lines)}] if lines else []), *tables]


def load_docx(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sections) of DOCX files, as ``spark.read.format("binaryFile")`` gives them; damaged files have none."""
    ship(files.sparkSession)
    inner = pa.list_(pa.struct([("heading", pa.string()), ("body", pa.string())]))

    def read(data: bytes | None) -> list[dict]:
        try:
            return docx_sections(data or b"")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return []

    @F.arrow_udf(SECTIONS)
    def sections(column: pa.Array) -> pa.Array:
        return by_slices(lambda own: [read(x) for x in own], inner, column)

    return files.select(F.col(path).alias("path"), sections(F.col(content)).alias("sections"))


def loader_for(path: Column) -> Column:
    """The loader whose paths these are: pdf, html, latex, docx, else null."""
    p = F.lower(path)
    return F.when(p.endswith(".pdf"), "pdf").when(p.rlike(r"\.html?$|^http"), "html").when(p.rlike(r"\.(tex|latex)$"), "latex").when(p.endswith(".docx"), "docx")
