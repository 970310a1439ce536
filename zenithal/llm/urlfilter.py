"""URL rules by a sorted digest array.

A rule is (host, path, verdict). It fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's path; of all that fit, the longest (host and path together) decides, of equally long ones that with the longer host.
Rules are kept as the ascending 64-bit xxhash digests of host and path, and beside them, in the same order, their full strings
and where each begins. Executors memory-map all of it and, for a batch of urls, look all (host suffix, path prefix) pairs up by
one vectorised binary search; a digest that is found only counts if the full string is the same, so collisions can't decide
anything.

The files go through the shared folder and ``addFile``, written as Spark sorts the rules, never whole in the driver, and only
for rule tables of at most ``max_mapped`` rows (a checked count), as every executor holds them on its disk. Larger tables are
joined by digest instead, with the same results.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.llm.skew import join_counted
from zenithal.session import materialize, shared_dir, ship

#: The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
RESULT = "rule string, verdict string"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``, in place of columns of these names; both empty where the url is null or
    has no ``://``."""
    whole = F.col(f"`{url}`")
    rest = F.when(F.instr(whole, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", F.coalesce(low, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit("")))


def suffixes(host: str, labels: int, length: int) -> list[str]:
    """The host and the domains above it, longest first, of at most so many labels and characters; none for an empty host."""
    if not host:
        return []
    parts = host.rsplit(".", labels)  # what is left of the last labels is one part
    whole = len(parts) <= labels
    names = [".".join(parts[i:]) for i in range(0 if whole else 1, len(parts))]
    return [n for n in names if len(n) <= length]


def rule_key(host: str, path: str) -> str:
    """One string of both: no host has a NUL, so different rules differ."""
    return f"{host}\0{path}"


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode(), 42)


def candidates(host: str, path: str, paths: list[int], labels: int, length: int) -> list[tuple[str, str]]:
    """All (host, path) of rules that could fit, the one to decide first."""
    tails = [path[:n] for n in paths if n <= len(path)]
    both = [(h, t) for h in suffixes(host, labels, length) for t in tails]
    return sorted(both, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


class RuleArray:
    """The mapped files: ascending digests, the strings ``key NUL verdict`` in that order, and where each of them begins."""

    def __init__(self, digests: str, texts: str, starts: str):
        open_ = lambda p, kind: np.memmap(p, dtype=kind, mode="r") if os.path.getsize(p) else np.empty(0, kind)
        self.digests, self.texts, self.starts = open_(digests, "<u8"), open_(texts, "u1"), open_(starts, "<u8")

    def probe(self, keys: list[str], digests: np.ndarray | None = None) -> list[str | None]:
        """For each key its verdict, or None: binary search over all, then the strings are compared."""
        if not keys or not len(self.digests):
            return [None] * len(keys)
        wanted = np.array([digest(k) for k in keys], np.uint64) if digests is None else digests
        at = np.searchsorted(self.digests, wanted)
        out: list[str | None] = [None] * len(keys)
        for j in np.nonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted)[0].tolist():
            i, own = int(at[j]), keys[j].encode() + b"\0"
            while i < len(self.digests) and self.digests[i] == wanted[j]:  # equal digests stand next to each other
                text = self.texts[int(self.starts[i]) : int(self.starts[i + 1])].tobytes()
                if text.startswith(own):
                    out[j] = text[len(own) :].decode()
                    break
                i += 1
        return out


def judge(df: DataFrame, rules: DataFrame, default: str = "allow", max_mapped: int = 5_000_000) -> DataFrame:
    """``df`` (with host and path) plus ``rule`` (host + path of the rule that decides, else null) and ``verdict``; columns of
    these names are replaced, others may have any names.

    Without a fitting rule the verdict is ``default``: a list of rules says nothing against urls that are not on it. Rules
    with a null host, path or verdict are ignored, as is an empty host; of rules with the same host and path block (the
    greatest verdict) wins. A null host or path is empty. Of long hosts only so many labels are looked up as rules have. Empty
    tables give empty results, an empty rule table only defaults.
    """
    spark = df.sparkSession
    ship(spark)
    rules = rules.select("host", "path", "verdict").dropna().where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = materialize(rules, "rules")
    # What is looked up of a url: bounded by the rules, whatever the url.
    n, labels, length = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("host", r"\."))), F.max(F.length("host"))).first()
    paths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().orderBy(F.desc("n")).collect()]
    keep = [c for c in df.columns if c not in ("rule", "verdict")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("d"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    found = _mapped(rows, rules, paths, labels or 0, length or 0) if n <= max_mapped else _joined(rows, rules, paths, labels, length)
    return found.select(*[F.col(f"d.`{c}`").alias(c) for c in keep], F.col("j.rule").alias("rule"), F.coalesce("j.verdict", F.lit(default)).alias("verdict"))


def _mapped(rows: DataFrame, rules: DataFrame, paths: list[int], labels: int, length: int) -> DataFrame:
    names = _publish(rules)

    @F.pandas_udf(RESULT)
    def decide(hosts: pd.Series, paths_of: pd.Series) -> pd.DataFrame:
        array = RuleArray(*[SparkFiles.get(n) for n in names])
        each = [candidates(h, p, paths, labels, length) for h, p in zip(hosts, paths_of, strict=True)]
        found = array.probe([rule_key(*c) for own in each for c in own])
        out, at = [], 0
        for own in each:
            hit = next((i for i in range(len(own)) if found[at + i] is not None), None)
            out.append((None, None) if hit is None else ("".join(own[hit]), found[at + hit]))
            at += len(own)
        return pd.DataFrame(out, columns=["rule", "verdict"])

    return rows.select("d", decide("host", "path").alias("j"))


def _publish(rules: DataFrame) -> list[str]:
    """Write the files to the shared folder and have every executor fetch them; returns their names."""
    spark = rules.sparkSession
    folder = shared_dir(spark, "rules")
    name, jvm = folder.rpartition("/")[2], spark._jvm
    names = [f"{name}.{part}" for part in ("digests", "texts", "starts")]
    paths = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in names]
    outs = [p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p) for p in paths]
    # Spark's xxhash64 of a string is XXH64 of its bytes with seed 42; its upper 63 bits, then the last one order it as unsigned.
    key = F.concat("host", F.lit("\0"), "path")
    ordered = rules.select(F.xxhash64(key).alias("h"), key.alias("k"), "verdict").orderBy(F.expr("shiftrightunsigned(h, 1)"), F.expr("h & 1L"), "k")
    held: list[list[bytes]] = [[], [], []]
    at = 0

    def flush():
        for out, parts in zip(outs, held, strict=True):
            out.write(bytearray(b"".join(parts)))
            parts.clear()

    for r in ordered.toLocalIterator():
        text = f"{r.k}\0{r.verdict}".encode()
        for parts, x in zip(held, (struct.pack("<q", r.h), text, struct.pack("<Q", at)), strict=True):
            parts.append(x)
        at += len(text)
        if len(held[0]) == 50_000:
            flush()
    held[2].append(struct.pack("<Q", at))
    flush()
    for out, p in zip(outs, paths, strict=True):
        out.close()
        spark.sparkContext.addFile(str(p.toString()))
    return names


def _joined(rows: DataFrame, rules: DataFrame, paths: list[int], labels: int, length: int) -> DataFrame:
    """The same for rule tables of any size: candidates of each distinct (host, path) meet the rules by digest."""
    parts = F.split("host", r"\.")
    tails = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in paths])
    last = F.sequence(F.greatest(F.size(parts) - labels + 1, F.lit(1)), F.size(parts))
    hosts = F.filter(F.transform(last, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")), lambda h: F.length(h) <= length)
    urls = rows.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("copies"))
    urls = materialize(urls, "urls")
    pairs = urls.select("host", "path", F.explode(hosts).alias("h"), tails.alias("ts")).withColumn("t", F.explode("ts")).where("t is not null")
    met = pairs.join(rules.select(F.col("host").alias("h"), F.col("path").alias("t"), "verdict"), ["h", "t"])
    best = F.max_by(F.struct(F.concat("h", "t").alias("rule"), "verdict"), F.struct(F.length(F.concat("h", "t")), F.length("h"))).alias("j")
    hits = met.groupBy("host", "path").agg(best)
    # Joined by one key of both, frequent urls by broadcast.
    hits = materialize(urls.join(hits, ["host", "path"]).select(F.struct("host", "path").alias("key"), "j", "copies"), "url-hits")
    return join_counted(rows.select("d", F.struct("host", "path").alias("key")), hits, "key", "copies", "left").select("d", "j")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` under the five rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = split_url(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""
