"""Shingle sets of texts and their exact Jaccard similarity: what confirms near-duplicates, and finds those beyond a radius.

Two sets with a similarity of at least 4/5 share at least ceil(4 n / 5) of the n shingles of either, so in any one order of
all shingles their first n - ceil(4 n / 5) + 1 have one in common. These prefixes are an index of candidates that misses no
pair. The order puts shingles that are frequent in a sample last, which keeps the index's groups small and changes no result.

Candidates are counted by the shingles that their prefixes share, or compared by marks (the parity of a set's shingles in each
of 512 classes), which rules most of them out. Sets of more shingles than that differ in about half of such marks whatever they
share, so their candidates are compared by marks with a class for each shingle. What is left is decided by the whole sets, made
anew from the whole texts of candidates only. No set of all texts is ever stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.llm.skew import join_counted
from zenithal.session import discard, materialize

#: Texts that frequent shingles are counted in (so many, or one in ``EVERY``, if that is more), and how many of these are put
#: last; none of it changes a result.
SAMPLE, EVERY, FREQUENT = 40_000, 50, 500_000
BATCH = 1000
#: Columns of 64 bits for the marks of a set.
MARKS = [f"m{k}" for k in range(8)]


def hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words in order, repeats included (of all words, where there are fewer); A-Z are
    lower-cased, words are parted by ASCII blanks. Empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks part words
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[len(words) - n :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The set of a text: its distinct hashes, sorted as signed numbers."""
    return np.unique(hashes(text, width).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def frequent(docs: DataFrame, text: Column, width: int) -> np.ndarray:
    """The most frequent shingles of a sample of texts, the most frequent last."""
    every = max(1, min(docs.count() // SAMPLE, EVERY))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                yield pa.RecordBatch.from_arrays([lists([shingles(t, width) for t in whole.column(0).slice(at, BATCH).to_pylist()])], ["h"])

    some = docs.select(text.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0)
    counts = some.mapInArrow(run, "h array<long>").select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where("n >= 3").orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    last = often.column(0).to_numpy()[::-1].copy() if often.num_rows else np.zeros(0, np.int64)
    del often
    pa.default_memory_pool().release_unused()
    return last


class Order:
    """An order of shingles: those of ``last`` after all others, in its order; others by their hash."""

    def __init__(self, last: np.ndarray):
        self.rank = np.argsort(last)
        self.place = last[self.rank]

    def prefix(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        k = np.searchsorted(self.place, h)
        hot = np.zeros(len(h), bool) if not len(self.place) else self.place[np.minimum(k, len(self.place) - 1)] == h
        ordered = np.concatenate([h[~hot], h[hot][np.argsort(self.rank[k[hot]])]])
        return ordered[: len(h) + 4 * len(h) // -5 + 1]


def alike(pairs: DataFrame) -> DataFrame:
    """Pairs of sets whose sizes (na, nb) allow a similarity of 4/5."""
    return pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)")


def early(n: Column) -> Column:
    """How many shingles of the prefix of a set of ``n`` are early: a pair at 4/5 shares one that is early in its smaller set.

    A pair shares at least 4 / 9 of both sizes, so 8 / 9 of the smaller one; of these one is among its first n - ceil(8 n / 9) + 1,
    and in the larger set among the first that the prefix has."""
    return n - F.floor((8 * n + 8) / 9) + 1


def count_shared(pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb) of pairs that come with numbers ``w`` of shingles that their prefixes share, if these leave 4/5 possible.

    All that prefixes don't share is in the rest of the set whose prefix ends first, so few shared shingles rule a pair out."""
    rest = lambda n: F.ceil(F.col(n) * 4 / F.lit(5)) - 1
    counted = alike(pairs).groupBy("a", "b", "na", "nb").agg(F.sum("w").alias("c"))
    return counted.where((F.col("c") + F.greatest(rest("na"), rest("nb"))) * 9 >= (F.col("na") + F.col("nb")) * 4).drop("c")


def marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """The columns ``MARKS`` of sets: each shingle turns over one of their bits, by its last bits."""
    bits = 64 * len(MARKS)
    out = np.array([np.bincount(s & (bits - 1), minlength=bits) & 1 for s in sets], np.uint8).reshape(-1, bits)
    words = np.packbits(out, axis=1).view(np.int64)
    return [pa.array(words[:, k].copy()) for k in range(len(MARKS))]


def wide_marks(sets: list[np.ndarray]) -> pa.Array:
    """For each set of more shingles than the bits of ``MARKS`` as many bits as it has shingles, or more (a power of two times
    those), as bytes: wider ones fold into narrower ones by XOR. Null for other sets."""
    least, out = 64 * len(MARKS), []
    for s in sets:
        bits = least << max(0, (len(s) - 1) // least).bit_length()
        out.append(None if bits == least else np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes())
    return pa.array(out, pa.binary())


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two wide marks differ, when the wider one is folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def possible_wide(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that wide marks (``wide`` of ``texts``) leave possible, see :func:`possible`; all those with a
    text that has none."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                rows = zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)
                keep = [x is None or y is None or 9 * differing(x, y) <= na + nb for na, nb, x, y in rows]
                yield b.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    wide = texts.where("wide is not null")
    met = pairs.join(wide.select(F.col("id").alias("a"), F.col("wide").alias("wa")), "a", "left").join(wide.select(F.col("id").alias("b"), F.col("wide").alias("wb")), "b", "left")
    return met.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long, na long, nb long")


def possible(a: str, b: str) -> Column:
    """Whether sizes and marks (structs ``m`` and the end's name) of a pair leave a similarity of 4/5 possible.

    Marks differ in no more bits than there are shingles in one set only, which are a ninth of both sizes at most."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    differ = sum((F.bit_count(F.col(f"m{a}.{m}").bitwiseXOR(F.col(f"m{b}.{m}"))) for m in MARKS), F.lit(0))
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * differ <= na + nb)


def confirm(pairs: DataFrame, texts: DataFrame, docs: DataFrame, digest: Column, text: Column, width: int) -> DataFrame:
    """The pairs (a, b) of ids with a similarity of at least 4/5, decided by the whole sets.

    ``texts``: (id, digest, copies, wide) of all distinct texts; ``docs``: where their texts are, by ``digest`` and ``text``."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([b.column(0), lists([shingles(t, width) for t in b.column(1).to_pylist()])], ["id", "hashes"])

    pairs = materialize(possible_wide(pairs.select("a", "b", "na", "nb").distinct(), texts), "jaccard-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(texts.join(ids, "id").select("id", "digest", "copies"), "jaccard-wanted")
    own = join_counted(docs.select(digest.alias("digest"), text.alias("text")), wanted, "digest", "copies")
    own = own.groupBy("id").agg(F.first("text").alias("text"))
    sets = materialize(own.select("id", "text").mapInArrow(run, "id long, hashes array<long>"), "jaccard-sets")
    near = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    links = materialize(near.where(both * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b"), "jaccard-links")
    for done in (sets, wanted, pairs):
        discard(done)
    return links
