"""Element sets from text files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, line) of text files; each file is one row on the way, as its lines must keep their order."""
    blobs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return blobs.select("file", F.posexplode("lines").alias("place", "line"))


def sets(lines: DataFrame) -> DataFrame:
    """(file, name, line1, line2) from (file, place, line): a name with the two lines after it, or a line that starts with
    ``1 `` with the one after it; blank lines and comments don't count, what fits neither is skipped line by line.

    Where a set begins depends on where the one before it ended, so the lines of a file are walked in order."""
    kept = lines.withColumn("line", F.rtrim(F.regexp_replace("line", r"[\r\n\t]+$", ""))).where((F.length("line") > 0) & ~F.col("line").startswith("#"))
    kind = lines.schema["file"].dataType.simpleString()

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        text, out, i = table.column("line").to_pylist(), [], 0
        while i < len(text):
            if i + 2 < len(text) and not text[i].startswith(("1 ", "2 ")):
                out.append((text[i].strip(), text[i + 1], text[i + 2]))
                i += 3
            elif i + 1 < len(text) and text[i].startswith("1 "):
                out.append((f"NORAD-{text[i][2:7].strip()}", text[i], text[i + 1]))
                i += 2
            else:
                i += 1
        names, first, second = zip(*out, strict=True) if out else ((), (), ())
        file = table.column("file").combine_chunks().slice(0, 1).to_pylist() * len(out)
        return pa.table({"file": pa.array(file, table.schema.field("file").type), "name": pa.array(names, pa.string()), "line1": pa.array(first, pa.string()), "line2": pa.array(second, pa.string())})

    return kept.select("file", "place", "line").groupBy("file").applyInArrow(walk, f"file {kind}, name string, line1 string, line2 string")


def strict_sets(lines: DataFrame) -> DataFrame:
    """(file, name, line1, line2) of three lines in a row that are a name, a first and a second line; needs no walk."""
    w = W.partitionBy("file").orderBy("place")
    kept = lines.where((F.length(F.trim("line")) > 0) & ~F.col("line").startswith("#"))
    ahead = kept.select("file", F.col("line").alias("name"), F.lead("line", 1).over(w).alias("line1"), F.lead("line", 2).over(w).alias("line2"))
    return ahead.where(F.col("line1").startswith("1 ") & F.col("line2").startswith("2 ") & ~F.substring("name", 1, 2).isin("1 ", "2 "))
