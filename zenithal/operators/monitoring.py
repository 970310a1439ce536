"""Monitoring rules over event tables: increases, staleness, ratios, quantiles of buckets, burn-in summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.functions.frames import micros


def increase(df: DataFrame, key: str, time: str, hours: int) -> DataFrame:
    """``df`` plus ``increase``: events of the same key in the trailing window of each row, itself included.

    Time is cut into buckets as long as the window, so that it reaches into the bucket before and no further. Each event also stands
    in the next bucket, at the time at which it has left the window: a running sum counts those that have come in the own bucket,
    and those of the bucket before that have not left. So the cost of a row does not depend on how many the window holds, and a
    key with very many rows is many tasks."""
    span = hours * 3_600_000_000
    t = micros(F.col(time))
    rows = df.select(F.struct(*df.columns).alias("_r"), F.col(key).alias("_k"), t.alias("_t"), ((t - F.pmod(t, F.lit(span))) / span).cast("long").alias("_b"), F.lit(0).alias("_left"))
    leave = rows.select("_k", (F.col("_t") + span + 1).alias("_t"), (F.col("_b") + 1).alias("_b"), F.lit(1).alias("_left"))
    w = W.partitionBy("_k", "_b")
    upto = w.orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    count = F.sum(1 - F.col("_left")).over(upto) + F.sum("_left").over(w) - F.sum("_left").over(upto)
    both = rows.unionByName(leave, allowMissingColumns=True).withColumn("increase", count)
    return both.where("_left = 0").select("_r.*", "increase")


def staleness(df: DataFrame, key: str, time: str, as_of: Column, limits: dict[str, int], otherwise: int) -> DataFrame:
    """(key, seconds, stale): time since the last event of each key against its limit."""
    last = df.groupBy(key).agg(F.max(time).alias("last"))
    limit = F.lit(otherwise)
    for name, seconds in limits.items():
        limit = F.when(F.col(key) == name, seconds).otherwise(limit)
    age = F.timestamp_diff("SECOND", F.col("last"), as_of)
    return last.select(key, age.alias("seconds"), (age > limit).alias("stale"))


def bucket_quantile(buckets: DataFrame, key: str, q: float) -> DataFrame:
    """(key, quantile) from cumulative buckets (key, le, n): linear within the bucket; in the last, unbounded one its lower
    bound is the answer. There are few buckets for a key."""
    total = buckets.groupBy(key).agg((F.max("n") * q).alias("rank"))
    w = W.partitionBy(key).orderBy("le")
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0))).join(total, key)
    hit = rows.where("n >= rank").groupBy(key).agg(F.min(F.struct("le", "n", "low", "before", "rank")).alias("b")).select(key, "b.*")
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / (F.col("n") - F.col("before"))
    return hit.select(key, F.when(F.col("le") == float("inf"), F.col("low")).when(F.col("n") == F.col("before"), F.col("le")).otherwise(inside).alias("quantile"))


def burn_in(df: DataFrame, key: str, time: str, latency: str, ok: Column, last: int = 100) -> DataFrame:
    """(key, polls, outages, uptime_pct, first_error, last_error, p95 of the last good latencies)."""
    per = df.withColumn("_ok", ok)
    counts = per.groupBy(key).agg(F.count(F.lit(1)).alias("polls"), F.count_if(~F.col("_ok")).alias("outages"), F.min(F.when(~F.col("_ok"), F.col(time))).alias("first_error"), F.max(F.when(~F.col("_ok"), F.col(time))).alias("last_error"))
    w = W.partitionBy(key).orderBy(F.desc(time))
    recent = per.where("_ok").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last)
    s = F.sort_array(F.collect_list(latency))
    p95 = recent.groupBy(key).agg(F.get(s, F.least(F.floor(F.size(s) * 0.95), F.size(s) - 1).cast("int")).alias("p95"))
    out = counts.join(p95, key, "left")
    return out.withColumn("uptime_pct", F.round(100 * (F.col("polls") - F.col("outages")) / F.col("polls"), 2))
