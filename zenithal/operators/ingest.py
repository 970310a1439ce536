"""Knowledge ingestion and provenance: contradictions, their resolution, reviews, snapshots, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.operators.joins import latest_per_key

#: A difference in confidence over the limit decides; names of fields that decide how urgent a review is.
LIMIT = 0.15
URGENT = ["display_name", "entity_class", "entity_subclass", "norad_id", "cospar_id", "payload_leo_kg", "orbit_regime", "operator_aqid", "launch_date", "manufacturer_aqid"]
SETTLED = ["ai_executive_summary", "ai_extended_analysis", "record_completeness", "updated_at"]
VALUABLE = ["payload_leo_kg", "norad_id", "cospar_id", "orbit_regime", "launch_date", "total_launches", "success_rate_pct", "altitude_km", "inclination_deg", "period_min"]


def resolution(incoming: Column, existing: Column, limit: float = LIMIT) -> Column:
    """override, reject or dispute by the difference of two confidences, as decimals: exactly the limit is a dispute."""
    delta = incoming.cast("decimal(12,6)") - existing.cast("decimal(12,6)")
    return F.when(delta > F.lit(limit).cast("decimal(12,6)"), "override").when(delta < F.lit(-limit).cast("decimal(12,6)"), "reject").otherwise("dispute")


def same_value(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    """Equal texts, or numbers that differ by less than the tolerance relative to the first."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce((a == b) | (F.abs(x - y) / F.greatest(F.abs(x), F.lit(1e-9)) < tolerance), F.lit(False))


def primary_facts(facts: DataFrame) -> DataFrame:
    """One live primary fact for each (aqid, field): the surest, then the newest."""
    live = facts.where("is_primary and not superseded")
    return latest_per_key(live, ["aqid", "field"], [F.col(c) for c in ("confidence", "created", "fact_id", "value")])


def contradictions(incoming: DataFrame, facts: DataFrame, settled: list[str] = SETTLED) -> DataFrame:
    """Incoming facts (aqid, field, value, confidence, fact_id) that differ from the primary ones, with what follows:
    resolution, status, and the priority of a review where it takes one."""
    old = primary_facts(facts).select("aqid", "field", F.col("value").alias("old_value"), F.col("confidence").alias("old_confidence"), F.col("fact_id").alias("old_fact_id"))
    met = incoming.where(~F.col("field").cast("string").isin(settled)).join(old, ["aqid", "field"])
    met = met.where(~same_value(F.col("old_value").cast("string"), F.col("value").cast("string")))
    out = met.withColumn("resolution", resolution(F.col("confidence"), F.col("old_confidence")))
    dispute = F.col("resolution") == "dispute"
    return out.withColumn("status", F.when(dispute, "pending_review").otherwise("auto_resolved")).withColumn("priority", F.when(dispute, F.when(F.col("field").cast("string").isin(URGENT), "high").otherwise("medium")))


def apply_resolutions(facts: DataFrame, found: DataFrame) -> DataFrame:
    """The ledger after resolutions: overridden facts are superseded by the incoming ones (by fact id)."""
    gone = found.where("resolution = 'override'").groupBy(F.col("old_fact_id").alias("fact_id"), "aqid", "field").agg(F.max("fact_id").alias("superseded_by"))
    out = facts.join(gone, ["fact_id", "aqid", "field"], "left")
    hit = F.col("superseded_by").isNotNull()
    return out.withColumn("is_primary", F.col("is_primary") & ~hit).withColumn("superseded", F.col("superseded") | hit)


def map_differences(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """(key, field, before, after) of fields that both maps hold with different values."""
    rows = lambda df, name: df.select(key, F.explode(column).alias("field", name))
    return rows(old, "before").join(rows(new, "after"), [key, "field"]).where("before <> after")


def normalise(records: DataFrame, tier: Column) -> DataFrame:
    """Records with the greater of their own confidence and their tier's, their id, and warnings as an array."""
    from zenithal.functions.ids import TIER_CONFIDENCE, aqid, entity_class, lookup

    kind = entity_class(F.col("raw_type"))
    sure = F.greatest(F.col("confidence"), lookup(tier, TIER_CONFIDENCE, 0.5))
    warnings = F.array_compact(F.array(F.when(kind.isNull(), "unknown type"), F.when(F.length(F.trim("name")) == 0, "no name")))
    return records.withColumn("entity_class", kind).withColumn("confidence", sure).withColumn("aqid", aqid(kind, F.col("name"))).withColumn("warnings", warnings)


def snapshot(df: DataFrame, key: str, version: Column) -> DataFrame:
    """(key, version, state as JSON): a row to append to the history."""
    return df.select(key, version.alias("version"), F.to_json(F.struct(*sorted(df.columns))).alias("state"))


def due(schedule: DataFrame, as_of: Column) -> DataFrame:
    """Schedules that are enabled and whose next run is not after ``as_of`` (or was never set)."""
    return schedule.where(F.col("enabled") & (F.col("next_run").isNull() | (F.col("next_run") <= as_of)))
