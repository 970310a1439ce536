"""Filters: optional conjunctions, substring and symmetric key predicates, validity in time."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column | None]) -> Column:
    """The conditions that are given, all of them; true where none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equals(**wanted) -> list[Column | None]:
    """A condition for every column whose wanted value is not None; a list means any of its values."""
    test = lambda k, v: F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v
    return [None if v is None else test(k, v) for k, v in wanted.items()]


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive substring; wildcards in ``text`` stand for themselves."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def search(text: str, names: list[str], key: str) -> Column:
    """Substring of any of the named columns or, for digits, the key itself."""
    hit = reduce(lambda a, b: a | b, [contains_text(F.col(n), text) for n in names])
    return hit | (F.col(key) == int(text)) if text.isdigit() else hit


def touches(keys: DataFrame, rows: DataFrame, key: str, columns: tuple[str, str], row_id: str) -> DataFrame:
    """Rows one of whose two columns is a key: both columns become one, met by a semi join, so any number of keys will do."""
    ends = rows.select(row_id, F.explode(F.array(*columns)).alias(key)).join(keys.select(key), key, "left_semi")
    return rows.join(ends.select(row_id).distinct(), row_id, "left_semi")


def within(column: Column, start: Column, hours: int) -> Column:
    """From ``start`` up to ``hours`` later, both ends included."""
    return column.between(start, start + F.make_dt_interval(F.lit(0), F.lit(hours)))


def valid_at(at: Column, since: Column, until: Column) -> Column:
    """Bounds that are null are open."""
    return (since.isNull() | (since <= at)) & (until.isNull() | (until >= at))


def overlaps(column: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted]))


def relationship_errors(src: Column, dst: Column, since: Column, until: Column, confidence: Column, id_pattern: str) -> Column:
    """What is wrong with an edge, as an array."""
    tests = [("invalid source", ~src.rlike(id_pattern)), ("invalid target", ~dst.rlike(id_pattern)), ("self reference", src == dst), ("until before since", until < since), ("confidence out of range", ~confidence.between(0, 1))]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]))


def good_chunk(text: Column, tokens: Column, least_tokens: int = 80) -> Column:
    """Enough tokens, at most 15 % of characters beyond ASCII, at least 40 % letters, at most three reference lines."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    n = F.length(t)
    beyond = n - F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    references = F.regexp_count(t, F.lit(r"(?m)^\[[0-9]+\]"))
    return F.coalesce((n > 0) & (tokens >= least_tokens) & (beyond <= 0.15 * n) & (letters >= 0.4 * n) & (references <= 3), F.lit(False))
