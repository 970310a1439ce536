"""Metrics in flight: counters beside a running query, and quantiles of any range from stored, mergeable sketches.

A KLL sketch of each key and hour is kept as a row; quantiles of a day, a month or of everything come from merging the rows of
those hours, so no value is read again, and late hours are merged in as they come. With ``k`` = 200 a rank is off by less
than 1.7 % (:func:`rank_error`); up to about ``k`` values in all, a quantile is exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.session import materialize


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that Spark computes while whatever comes after runs; ``observation.get`` has them then."""
    seen = Observation()
    return df.observe(seen, *[m.alias(n) for n, m in metrics.items()]), seen


def rank_error(k: int) -> float:
    """The share of ranks by which a quantile of a sketch of size ``k`` may be off, in 99 of 100 cases."""
    return 2.296 / k**0.9021


def hourly(events: DataFrame, key: str, time: str, value: str, k: int = 200) -> DataFrame:
    """(key, hour, n, sum, sketch), a written table with a row for each key and hour. Null values don't count; rows without a time do
    not either. Sketches are begun in each task and merged, so a hot key is a row from each task."""
    rows = events.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    hour = F.date_trunc("hour", F.col(time)).cast(events.schema[time].dataType).alias("hour")
    out = rows.groupBy(F.col(key).alias("key"), hour).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(38,6)")).alias("sum"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))
    return materialize(out, "metric-sketches")


def quantiles(sketches: DataFrame, qs: dict[str, float], by: Column | None = None, k: int = 200) -> DataFrame:
    """(key, [period,] n, one column for each of ``qs``) merged over all rows of ``sketches``, or over those of each ``by``."""
    groups = [F.col("key")] if by is None else [F.col("key"), by.alias("period")]
    merged = sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    return merged.select("key", *([] if by is None else ["period"]), "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(name) for name, q in qs.items()])


def exact_quantiles(events: DataFrame, sketches: DataFrame, key: str, time: str, value: str, qs: dict[str, float], unit: str, k: int = 200) -> DataFrame:
    """(key, period, n, one column for each of ``qs``): the values at rank ``ceil(q n)`` of each period (a ``date_trunc`` unit), exactly.

    The sketches of :func:`hourly` give a range of values that holds the rank but seldom not; values below it are counted, those
    within are ranked. Where a range doesn't hold its rank, all values of that period are ranked."""
    period = lambda c: F.date_trunc(unit, F.col(c)).cast("date")
    slack = 4 * rank_error(k)
    around = {f"{n}_{side}": min(max(q + sign * slack, 0.0), 1.0) for n, q in qs.items() for side, sign in (("low", -1), ("high", 1))}
    guess = materialize(quantiles(sketches, around, period("hour"), k).withColumnsRenamed({"key": "_k", "period": "_p"}), "metric-ranges")
    rows = events.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), period(time).alias("period"), F.col(value).cast("double").alias("v"))
    same = F.col("key").eqNullSafe(F.col("_k")) & (F.col("period") == F.col("_p"))
    met = rows.join(guess, same)
    counts = met.groupBy("_k", "_p").agg(F.first("n").alias("n"), *[c for n in qs for c in (F.first(f"{n}_low").alias(f"{n}_low"), F.first(f"{n}_high").alias(f"{n}_high"), F.count_if(F.col("v") < F.col(f"{n}_low")).alias(f"{n}_below"), F.count_if(F.col("v") <= F.col(f"{n}_high")).alias(f"{n}_upto"))])
    asked = []
    for n, q in qs.items():
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))
        held = (F.col(f"{n}_below") < rank) & (rank <= F.col(f"{n}_upto"))
        asked.append(F.struct(F.lit(n).alias("name"), F.when(held, F.col(f"{n}_low")).otherwise(float("-inf")).alias("low"), F.when(held, F.col(f"{n}_high")).otherwise(float("nan")).alias("high"), (rank - F.when(held, F.col(f"{n}_below")).otherwise(0)).alias("rank")))
    ranges = materialize(counts.select("_k", "_p", "n", F.array(*asked).alias("asked")), "metric-ranges")
    inside = F.filter("asked", lambda a: (F.col("v") >= a["low"]) & (F.col("v") <= a["high"]))
    each = rows.join(ranges, same).select("_k", "_p", "n", "v", F.explode(inside).alias("a")).groupBy("_k", "_p", "n", "a.name", "a.rank", "v").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(W.partitionBy("_k", "_p", "name").orderBy("v"))
    at = each.withColumn("_upto", upto).where("_upto >= rank and _upto - _m < rank")
    return at.groupBy(F.col("_k").alias("key"), F.col("_p").alias("period"), "n").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in qs])
