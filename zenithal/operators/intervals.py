"""Intervals that hold a point, for many points at once: a join by nested buckets, without a copy for each unit of time.

Time is whole numbers (days). At level i a bucket holds 2**i of them. An interval is covered by the fewest buckets, at most two
of each level, so an edge of a hundred years has some twenty rows; a point lies in one bucket of each level. The buckets of an
interval are disjoint, so a point meets it once. The join is on (level, bucket). Open ends reach as far as the points do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKETS = "array<struct<level:int,bucket:bigint>>"


def cover(first: Column, last: Column, levels: int) -> Column:
    """The fewest buckets of levels below ``levels`` that hold ``first`` to ``last`` (both included, not negative); none if last < first."""

    def step(s: Column, i: Column) -> Column:
        some = s["a"] < s["b"]
        take = lambda if_odd, bucket: F.when(some & (if_odd % 2 == 1), F.array(F.struct(i.alias("level"), bucket.alias("bucket")))).otherwise(F.array().cast(_BUCKETS))
        out = F.concat(s["out"], take(s["a"], s["a"]), take(s["b"], s["b"] - 1))
        return F.struct(F.floor((s["a"] + 1) / 2).alias("a"), F.floor(s["b"] / 2).alias("b"), out.alias("out"))

    start = F.struct(first.cast("long").alias("a"), (last.cast("long") + 1).alias("b"), F.array().cast(_BUCKETS).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, lambda s: s["out"])


def _span(points: DataFrame, point: str) -> tuple[int, int] | None:
    r = points.agg(F.min(point).alias("low"), F.max(point).alias("high")).first()
    return None if r.low is None else (r.low, (r.high - r.low + 1).bit_length() + 1)


def _covered(intervals: DataFrame, start: str, end: str, low: int, levels: int) -> DataFrame:
    """``intervals`` with a row for each of their buckets (``_level``, ``_bucket``), counted from the first point."""
    top = (1 << (levels - 1)) - 1
    first = F.greatest(F.coalesce(F.col(start).cast("long") - low, F.lit(0)), F.lit(0))
    last = F.least(F.coalesce(F.col(end).cast("long") - low, F.lit(top)), F.lit(top))
    cut = intervals.withColumn("_c", F.explode(cover(first, last, levels)))
    return cut.select(*intervals.columns, F.col("_c.level").alias("_level"), F.col("_c.bucket").alias("_bucket"))


def _in_buckets(points: DataFrame, point: str, low: int, levels: int) -> DataFrame:
    every = points.where(F.col(point).isNotNull()).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return every.withColumn("_bucket", F.expr(f"shiftright(CAST(`{point}` AS BIGINT) - {low}, _level)"))


def holding(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str) -> DataFrame:
    """Every pair of a row of ``points`` and a row of ``intervals`` with start <= point <= end; a null end is open. Column names
    must differ. Intervals that hold no point and points without an interval don't appear."""
    if (span := _span(points, point)) is None:
        return points.where("false").join(intervals.where("false"), how="cross")
    low, levels = span
    met = _in_buckets(points, point, low, levels).join(_covered(intervals, start, end, low, levels), ["_level", "_bucket"])
    return met.drop("_level", "_bucket")


def counts_at(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, groups: list[str]) -> DataFrame:
    """(point, *groups, n): how many intervals of each group hold each distinct point; groups without any don't appear.

    Intervals are counted by bucket before the join, so what is joined are buckets, however many intervals there are."""
    distinct = points.select(point).where(F.col(point).isNotNull()).distinct()
    if (span := _span(distinct, point)) is None:
        return distinct.join(intervals.select(*groups).where("false"), how="cross").withColumn("n", F.lit(0).cast("long"))
    low, levels = span
    per = _covered(intervals.select(*groups, start, end), start, end, low, levels).groupBy("_level", "_bucket", *groups).agg(F.count(F.lit(1)).alias("n"))
    met = _in_buckets(distinct, point, low, levels).join(per, ["_level", "_bucket"])
    return met.groupBy(point, *groups).agg(F.sum("n").alias("n"))


def merged(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): the intervals of each key, those that overlap as one, so that a point lies in one of a key at most. Null
    ends are open; intervals that end before they start are left out."""
    low, high = -(1 << 62), 1 << 62
    rows = intervals.select(key, F.coalesce(F.col(start).cast("long"), F.lit(low)).alias("_a"), F.coalesce(F.col(end).cast("long"), F.lit(high)).alias("_b")).where("_a <= _b").distinct()
    w = W.partitionBy(key).orderBy("_a", "_b")
    rows = rows.withColumn("_new", (F.col("_a") > F.coalesce(F.max("_b").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(low - 1))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy(key, "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return runs.select(key, F.when(F.col("_a") > low, F.col("_a")).alias(start), F.when(F.col("_b") < high, F.col("_b")).alias(end))
