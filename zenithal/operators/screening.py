"""Services over element sets: states, ground tracks, passes over a site, close-approach screening, a table's generic calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.functions import frames, orbit, probability
from zenithal.operators import joins, ordered, propagation
from zenithal.session import materialize

XYZ = ("x", "y", "z")


def epochs(spark, start: str, steps: int, step_seconds: int) -> DataFrame:
    """A grid of ``steps`` epochs."""
    return spark.range(steps).select(F.timestamp_add("SECOND", (F.col("id") * step_seconds).cast("int"), F.expr(f"TIMESTAMP_NTZ'{start}'")).alias("epoch"))


def states(sets: DataFrame, grid: DataFrame) -> DataFrame:
    """(norad_id, epoch, x, y, z, vx, vy, vz) of every set at every epoch; failed ones are left out."""
    rows = propagation.at_epochs(sets, grid).where("state.error = 0")
    return rows.select("norad_id", "epoch", *[f"state.{c}" for c in (*XYZ, "vx", "vy", "vz")])


def ground_track(sets: DataFrame, grid: DataFrame) -> DataFrame:
    """(norad_id, epoch, lat_deg, lon_deg, alt_km) above the ellipsoid."""
    s = states(sets, grid).withColumn("_angle", frames.gmst(F.col("epoch")))
    fixed = s.select("norad_id", "epoch", *[c.alias(n) for n, c in zip(XYZ, frames.rotate([F.col(c) for c in XYZ], F.col("_angle")), strict=True)])
    return frames.add_geodetic(fixed, XYZ).drop(*XYZ)


def passes(sets: DataFrame, grid: DataFrame, lat_deg: float, lon_deg: float, alt_km: float, least_deg: float = 5.0) -> DataFrame:
    """Rise, culmination and set of every object over a site."""
    look = frames.look_angles([F.col(c) for c in XYZ], lat_deg, lon_deg, alt_km, frames.gmst(F.col("epoch")))
    seen = states(sets, grid).select("norad_id", "epoch", look["elevation_deg"].alias("elevation"))
    return ordered.passes(seen, ["norad_id"], "epoch", "elevation", least_deg)


def screen(sets: DataFrame, start: str, hours: float = 1.5, step_seconds: int = 60, distance_km: float = 5.0, radius_km: float = 0.02, sigma_km: tuple[float, float] = (0.2, 0.1)) -> DataFrame:
    """Pairs that are nearer than ``distance_km`` at ``start``, with the closest approach within ``hours``: distance, relative
    speed, probability by the short series, and risk. Only objects of such pairs are propagated over the grid."""
    spark = sets.sparkSession
    now = states(sets, epochs(spark, start, 1, 1))
    now = materialize(now.select("norad_id", *XYZ), "screen-now")
    pairs = joins.near_pairs(now, "norad_id", XYZ, distance_km)
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("norad_id")).distinct()
    own = sets.withColumn("norad_id", F.trim(F.substring("line1", 3, 5)).try_cast("int")).join(ids, "norad_id", "left_semi").drop("norad_id")
    ephemeris = materialize(states(own, epochs(spark, start, int(hours * 3600 / step_seconds) + 1, step_seconds)), "screen-states")
    best = joins.near_approaches(now, ephemeris, "norad_id", "epoch", XYZ, distance_km)
    at = lambda n: ephemeris.select(F.col("norad_id").alias(f"id_{n}"), F.col("epoch").alias("tca"), F.struct("vx", "vy", "vz").alias(f"v_{n}"))
    met = best.join(at("a"), ["id_a", "tca"]).join(at("b"), ["id_b", "tca"])
    speed = F.sqrt(sum((F.pow(F.col(f"v_a.{c}") - F.col(f"v_b.{c}"), 2.0) for c in ("vy", "vz")), F.pow(F.col("v_a.vx") - F.col("v_b.vx"), 2.0)))
    pc = probability.series(F.pow(F.col("distance") / sigma_km[0], 2.0), F.lit(sigma_km[0]), F.lit(sigma_km[1]), F.lit(radius_km))
    return met.select("id_a", "id_b", "tca", "distance", speed.alias("speed_kms"), pc.alias("pc"), orbit.risk_band(pc).alias("risk"))


class Table:
    """The generic calls on a table with a key: get, list, count, exists, delete."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key

    def get(self, value) -> DataFrame:
        return self.df.where(F.col(self.key) == value)

    def list(self, order: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        return self.df.orderBy(order or self.key, self.key).offset(offset).limit(limit)

    def count(self, condition: Column | None = None) -> int:
        return (self.df if condition is None else self.df.where(condition)).count()

    def exists(self, **equals) -> bool:
        from zenithal.operators.filters import all_of
        from zenithal.operators.filters import equals as tests

        return not self.df.where(all_of(tests(**equals))).isEmpty()

    def delete(self, value) -> DataFrame:
        """The table without the row."""
        return self.df.where(~F.col(self.key).eqNullSafe(value))
