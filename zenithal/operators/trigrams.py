"""Fuzzy name search by an inverted index of trigrams: a set of names meets a table without a scan for each name.

Names are made distinct; each has its trigrams in order of their frequency, rarest first. Two sets of sizes m and n with a
similarity (common ones over all) of at least t share one of the first ``m - ceil(t m) + 1`` and ``n - ceil(t n) + 1`` in that
order, so only these prefixes are indexed and looked up; sizes must be within t of each other; and where two prefixes first
meet, what is left of the shorter rest must be able to make up the overlap. Postings hold the whole set as numbers, so a candidate
is decided where its prefixes meet first, once, and only names that are similar enough leave the join.

What is asked for is broadcast as long as it is small, and postings stay where they are. Beyond that, a trigram that very many names
share is cut into pieces of at most ``PIECE`` postings; whoever looks it up goes to each piece.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.functions import text as T
from zenithal.operators.retrieval import bounded, parts, top
from zenithal.session import materialize

#: Postings of one trigram that one task may hold together, about.
PIECE = 1 << 15


def _ceil(x: Column) -> Column:
    return F.ceil(x - 1e-9)  # products like 0.3 * 10 must not land above their whole number


def _prefix(size: Column, least: float) -> Column:
    return (size - _ceil(size * least) + 1).cast("int")


@dataclass
class TrigramIndex:
    """``names`` (name, grams in order, size), ``grams`` (gram, names, pieces), and for similarities of ``least`` or more the
    ``postings`` (gram, piece, name, size, at, codes of all its trigrams in order, bits of these); all are written tables."""

    least: float
    names: DataFrame
    grams: DataFrame
    postings: DataFrame


def _codes(grams: Column) -> Column:
    """Trigrams as numbers: they are of a-z, 0-9 and blanks only."""
    at = lambda g, i: F.ascii(F.substring(g, i, 1))
    return F.transform(grams, lambda g: (at(g, 1) * 16384 + at(g, 2) * 128 + at(g, 3)).cast("int"))


def _bits(codes: Column) -> Column:
    """A bit for each number, of 64: two sets differ in as many numbers as their bits do, at least."""
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(64)))))


def _ordered(names: DataFrame, grams: DataFrame) -> DataFrame:
    """(name, grams, size): the trigrams of each name, rarest first; those that no indexed name has come before all."""
    each = names.select("name", F.explode(T.trigrams(F.col("name"))).alias("gram")).join(grams.select("gram", "names"), "gram", "left")
    row = F.sort_array(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("n"), "gram")))
    return each.groupBy("name").agg(row.alias("r")).select("name", F.transform("r", lambda x: x["gram"]).alias("grams"), F.size("r").alias("size"))


def build(table: DataFrame, name: str, least: float = 0.3) -> TrigramIndex:
    """An index of the distinct values of a column for similarities of ``least`` or more, above 0. Nulls and names without
    letters or digits have no trigrams and are never found."""
    names = materialize(table.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct(), "trigram-distinct")
    grams = names.select("name", F.explode(T.trigrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    grams = materialize(grams.withColumn("pieces", F.ceil(F.col("names") / PIECE).cast("int")), "trigram-grams")
    sets = materialize(_ordered(names, grams), "trigram-names")
    coded = sets.withColumn("codes", _codes(F.col("grams"))).withColumn("bits", _bits(F.col("codes")))
    heads = coded.select("name", "size", "codes", "bits", F.posexplode(F.slice("grams", F.lit(1), _prefix(F.col("size"), least))).alias("at", "gram"))
    postings = heads.join(grams.select("gram", "pieces"), "gram").select("gram", F.pmod(F.xxhash64("name"), F.col("pieces")).cast("int").alias("piece"), "name", "size", "at", "codes", "bits")
    return TrigramIndex(least, sets, grams, materialize(postings.repartition(parts(postings)), "trigram-postings"))


def search(index: TrigramIndex, asked: DataFrame, least: float | None = None) -> DataFrame:
    """(query, name, similarity): for each distinct value of ``asked`` (query) all indexed names of a similarity of ``least`` or
    more, which may not be below the index's own."""
    least = index.least if least is None else least
    if least < index.least:
        raise ValueError("the index holds prefixes for higher similarities only")
    wanted = asked.where("query is not null").select(F.col("query").alias("name")).distinct()
    sets = materialize(_ordered(wanted, index.grams).select(F.col("name").alias("query"), F.col("grams").alias("mine"), F.col("size").alias("own")), "trigram-asked")
    heads = sets.select("query", "own", _codes(F.col("mine")).alias("mine"), F.posexplode(F.slice("mine", F.lit(1), _prefix(F.col("own"), least))).alias("i", "gram"))
    heads = heads.withColumn("own_bits", _bits(F.col("mine")))
    heads = heads.join(index.grams.select("gram", "pieces"), "gram").select("query", "own", "mine", "own_bits", "i", "gram", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    fits = (F.col("size") >= _ceil(F.col("own") * least)) & (F.col("own") >= _ceil(F.col("size") * least))
    needed = _ceil((F.col("own") + F.col("size")) * (least / (1 + least)))
    rest = 1 + F.least(F.col("own") - F.col("i") - 1, F.col("size") - F.col("at") - 1)
    differ = F.bit_count(F.col("bits").bitwiseXOR(F.col("own_bits"))) <= F.col("own") + F.col("size") - 2 * needed
    before = F.arrays_overlap(F.slice("mine", F.lit(1), F.col("i")), F.slice("codes", F.lit(1), F.col("at")))
    met = index.postings.join(bounded(materialize(heads, "trigram-heads"), 1_000_000), ["gram", "piece"]).where(fits & (rest >= needed) & differ & ~before)
    common = F.size(F.array_intersect("mine", "codes"))
    return met.select("query", "name", (common / (F.col("own") + F.col("size") - common)).alias("similarity")).where(F.col("similarity") >= least)


def best_matches(index: TrigramIndex, asked: DataFrame, k: int = 20, least: float | None = None) -> DataFrame:
    """(query, name, similarity, rank): of each query the ``k`` most similar names, equal ones in order of the name."""
    return top(search(index, asked, least), "query", "similarity", "name", k).select("query", "name", "similarity", "rank")
