"""Aggregates of the domain: dashboards, profiles, densities, health."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.functions.orbit import EARTH_RADIUS_KM
from zenithal.operators.joins import band_join
from zenithal.operators.ordered import share_of_max


def exact_sum(column: str | Column) -> Column:
    """A sum of doubles that doesn't depend on the order of rows."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast("decimal(38,6)")).cast("double")


def counts_by(df: DataFrame, key: str, unknown: str = "unknown") -> DataFrame:
    """(key, n); a null key counts as ``unknown``."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(unknown)).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def samples(df: DataFrame, group: str, column: str, n: int) -> DataFrame:
    """(group, sample): the first ``n`` distinct values of a column in order, for each group that has any. Tasks cut their own
    distinct values to ``n`` before the shuffle, so no set of all values is ever gathered."""
    distinct = df.where(F.col(column).isNotNull()).select(group, column).distinct()
    first = distinct.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(column))).where(F.col("_k") <= n)
    return first.groupBy(group).agg(F.array_sort(F.collect_list(column)).alias("sample"))


def density_map(states: DataFrame, altitude: str, kind: str, shells: DataFrame) -> DataFrame:
    """One row per shell: objects by type, volume, density, congestion (share of the greatest density), exposure. Empty
    shells are rows, too; an object in two overlapping shells counts twice."""
    counted = band_join(states, altitude, shells, "alt_min", "alt_max").groupBy("alt_min", "alt_max").agg(
        F.count(F.lit(1)).alias("objects"), *[F.count_if(F.col(kind) == k).alias(n) for k, n in (("PAYLOAD", "satellites"), ("DEBRIS", "debris"), ("ROCKET_BODY", "rocket_bodies"))]
    )
    cells = shells.join(counted, ["alt_min", "alt_max"], "left").fillna(0)
    volume = 4.0 / 3.0 * math.pi * (F.pow(F.col("alt_max") + EARTH_RADIUS_KM, 3.0) - F.pow(F.col("alt_min") + EARTH_RADIUS_KM, 3.0))
    cells = share_of_max(cells.withColumn("density", F.col("objects") / volume), "density", "congestion")
    share = F.col("debris") / F.greatest(F.col("objects"), F.lit(1))
    return cells.withColumn("exposure", F.least(F.lit(1.0), F.col("congestion") * (1 + share)))


def regime_health(cells: DataFrame, conjunctions: DataFrame) -> DataFrame:
    """One row per regime from the cells of a density map and (regime, conjunctions): sustainability, alert, trend."""
    per = cells.groupBy("regime").agg(F.sum("objects").alias("objects"), F.sum("satellites").alias("satellites"), F.sum("debris").alias("debris"), F.max("congestion").alias("congestion"))
    per = per.join(conjunctions, "regime", "left").fillna(0, ["conjunctions"])
    share = F.col("debris") / F.greatest(F.col("objects"), F.lit(1))
    high = F.floor(F.col("conjunctions") / 5)
    alert = F.when((F.col("congestion") > 0.8) | (high > 10), "red").when((F.col("congestion") > 0.5) | (high > 5), "orange").when(F.col("congestion") > 0.3, "yellow").otherwise("green")
    return per.select(
        "regime", "objects", "satellites", "debris", "congestion", "conjunctions", high.alias("high_risk"),
        F.greatest(F.lit(0.0), 1.0 - F.col("congestion") * 0.5 - share * 0.3).alias("sustainability"), alert.alias("alert"), F.when(share > 0.5, "degrading").otherwise("stable").alias("trend"),
    )


def overall_alert(health: DataFrame) -> DataFrame:
    """One row: red if any regime is red, else orange if any is, else green; and the first three concerns by regime.

    There is a row per regime, so the list is small."""
    concern = F.when(F.col("alert").isin("red", "orange"), F.struct("regime", F.concat_ws(":", "regime", "alert").alias("text")))
    return health.agg(
        F.when(F.bool_or(F.col("alert") == "red"), "red").when(F.bool_or(F.col("alert") == "orange"), "orange").otherwise("green").alias("overall"),
        F.concat_ws(";", F.transform(F.slice(F.array_sort(F.collect_list(concern)), 1, 3), lambda s: s["text"])).alias("concerns"),
    )


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts (le, n) as a metrics registry exposes them, the last bucket being infinite."""
    edges = [*bounds, float("inf")]
    counts = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(edges)])
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(edges)])
    return counts.select(F.inline(rows))
