"""Ordered operators: top rows, pages, passes, running normalisation, scores against the own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in an order whose last column is unique, with the total and whether more follow."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(total)).withColumn("has_next", F.col("total") > number * size)


def passes(df: DataFrame, keys: list[str], time: str, elevation: str, least: float) -> DataFrame:
    """Runs of rows at or above ``least``: rise (first row), set (first row below), culmination, highest elevation, seconds.

    A run that is still open at the end is dropped; the culmination is the first of the highest rows."""
    w = W.partitionBy(*keys).orderBy(time)
    up = F.col(elevation) >= least
    rows = df.withColumn("_up", up).withColumn("_new", (F.col("_up") != F.lag("_up", 1, False).over(w)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w)).withColumn("_next", F.lead(time).over(w))
    runs = rows.where("_up").groupBy(*keys, "_run").agg(
        F.min(time).alias("aos"), F.max_by("_next", time).alias("los"), F.max(elevation).alias("max_elevation"), F.min_by(time, F.struct(-F.col(elevation), F.col(time))).alias("tca"),
    )
    return runs.where("los is not null").select(*keys, "aos", "los", "tca", "max_elevation", F.timestamp_diff("SECOND", F.col("aos"), F.col("los")).alias("duration_s"))


def z_scores(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` plus mean, deviation and score of each value against its key's rows (null deviation: no score)."""
    stats = df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    out = df.join(stats, key)
    return out.withColumn("z", F.when(F.col("deviation") > 0, (F.col(value) - F.col("mean")) / F.col("deviation")))


def share_of_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` plus each value's share of the greatest one (0 where that is 0): an aggregate that meets the rows again, not a
    window over everything."""
    top = df.agg(F.max(value).alias("_top"))
    share = F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(0.0)
    return df.join(F.broadcast(top)).withColumn(out, share).drop("_top")


def places(df: DataFrame, value: str, bins: int = 200) -> DataFrame:
    """``df`` plus ``place``: the rank of ``value``, the greatest first, equal ones alike; null values have none.

    Values are cut into ranges of about equal counts (bounds by approximate quantiles, which change no result). A range's first
    place is a running sum over ranges, and distinct values are ranked within their range, so no task has all of them."""
    bounds = sorted(set(df.approxQuantile(value, [i / bins for i in range(1, bins)], 0.001)))
    at = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]).cast("array<double>"), lambda x: x <= F.col(value)))
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v"), at.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    above = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = per.groupBy("_bin").agg(F.sum("_n").alias("_n")).select("_bin", above(W.orderBy(F.desc("_bin"))).alias("_before"))
    per = per.withColumn("_own", above(W.partitionBy("_bin").orderBy(F.desc("_v")))).join(F.broadcast(ranges), "_bin")  # one row for each of at most ``bins`` ranges
    return df.join(per.select("_v", (F.col("_before") + F.col("_own") + 1).alias("place")), F.col(value) == F.col("_v"), "left").drop("_v")
