"""Queries over propagation and re-entry (B16, B17, B31, B48)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zenithal.functions import orbit, tle
from zenithal.operators import joins, propagation
from zenithal.plans.registry import query
from zenithal.session import materialize

_XYZ = ("x", "y", "z", "vx", "vy", "vz")


def written_sets(t):
    """The element sets, dealt out and written once: checks and fields name the two lines some hundred times, and Spark would
    put the expressions that make them from the suppliers in place of each name when it moves filters down, in one task for a
    small file."""
    return materialize(t.tle_sets.repartition(max(t.partitions, t.spark.sparkContext.defaultParallelism), "set_id", "k"), "element-sets")


def latest_sets(t):
    """The latest set of each object, of equal epochs that with the greatest id."""
    f, sets = tle.fields(), written_sets(t)
    rows = sets.select(*sets.columns, f["norad_id"].alias("norad_id"), tle.epoch(f["epoch_year"], f["epoch_day"]).alias("set_epoch"))
    return joins.latest_per_key(rows, ["norad_id"], [F.col("set_epoch"), F.col("set_id"), F.col("k")]).drop("norad_id", "set_epoch")


def _epochs(t, n: int, step: int):
    return t.spark.range(n).select(F.timestamp_add("MINUTE", (F.col("id") * step).cast("int"), F.expr("TIMESTAMP_NTZ'2024-06-01 00:00:00'")).alias("epoch"))


@query("b16_sgp4")
def b16(t):
    """Every valid element set at its own epoch plus 0 to 90 minutes."""
    f = tle.fields()
    rows = written_sets(t).where(F.size(tle.errors()) == 0).select("set_id", "k", *[f[c].alias(c) for c in propagation.ELEMENTS])
    rows = propagation.propagate(rows.withColumn("minutes", F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(30)))), "minutes")
    return rows.select("set_id", "k", "minutes", "state.error", *[F.round(f"state.{c}", 6).alias(c) for c in _XYZ])


@query("b17_batch_propagation")
def b17(t):
    """All sets at a grid of epochs, and the success rate of each epoch."""
    states = propagation.at_epochs(written_sets(t), _epochs(t, 8, 15))
    ok = F.count_if(F.col("state.error") == 0)
    return states.groupBy("epoch").agg(F.count(F.lit(1)).alias("total"), ok.alias("nominal"), F.round(ok / F.count(F.lit(1)), 6).alias("rate"))


@query("b31_reentry")
def b31(t):
    i = F.col("norad_id")
    low = t.catalog.where("perigee_km < 350").withColumn("bstar", (i % 20 + 1) / 2e4)
    days = propagation.reentry_days(low, F.col("semi_major_axis_km"), F.col("eccentricity"), F.col("bstar"), F.lit(150.0))
    out = propagation.reentry_alert(F.col("days"), F.col("perigee_km"))
    return days.where("days is not null").select("norad_id", "days", out["alert"].alias("alert"), *[F.round(out[c], 6).alias(c) for c in ("uncertainty_hours", "survival", "footprint_km")])


@query("b48_orbit_forecast")
def b48(t):
    """A day of states every 5 minutes, folded to one row per set, with the decay rate."""
    f = tle.fields()
    rows = latest_sets(t).where(F.size(tle.errors()) == 0).select("set_id", *[f[c].alias(c) for c in [*propagation.ELEMENTS, "semi_major_axis_km"]])
    decay = F.abs(orbit.decay_km_day(F.col("semi_major_axis_km"), F.col("eccentricity"), F.col("bstar"), F.lit(150.0)))
    grid = rows.withColumn("decay", decay).withColumn("minutes", F.explode(F.sequence(F.lit(0), F.lit(1440), F.lit(5))))
    states = propagation.propagate(grid, "minutes").where("state.error = 0")
    height = F.sqrt(F.col("state.x") * F.col("state.x") + F.col("state.y") * F.col("state.y") + F.col("state.z") * F.col("state.z")) - orbit.EARTH_RADIUS_KM
    return states.groupBy("set_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.min(height), 3).alias("lowest_km"), F.round(F.max(height), 3).alias("highest_km"), F.round(F.first("decay"), 9).alias("decay_km_day"))


@query("b7_screening_elements", """
WITH p AS (SELECT set_id, k, CAST(trim(substr(line2, 9, 8)) AS DOUBLE) AS i, CAST('0.' || trim(substr(line2, 27, 7)) AS DOUBLE) AS e, CAST(trim(substr(line2, 53, 11)) AS DOUBLE) AS n FROM tle_sets),
a AS (SELECT *, pow(398600.4418e0 / pow(n * (2 * pi() / 86400), 2), 1e0 / 3) AS a FROM p) SELECT set_id, k, i AS inclination_deg, round(a * (1 - e) - 6378.137e0, 6) AS perigee_km, round(a * (1 + e) - 6378.137e0, 6) AS apogee_km FROM a""")
def b7(t):
    """What binning needs of a set, from the columns of its second line only."""
    f = tle.fields()
    return t.tle_sets.select("set_id", "k", "line2", F.lit("").alias("line1")).select("set_id", "k", f["inclination_deg"].alias("inclination_deg"), *[F.round(f[c], 6).alias(c) for c in ("perigee_km", "apogee_km")])
