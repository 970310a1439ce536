"""Satellite catalogues and registries from CSV and JSON, as records of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the public satellite catalogue and the names that records use.
FIELDS = {
    "NORAD_CAT_ID": "norad_id", "INTLDES": "cospar_id", "OBJECT_TYPE": "object_type", "SATNAME": "display_name", "COUNTRY": "country_code", "LAUNCH": "launch_date", "DECAY": "decay_date",
    "PERIOD": "period_min", "INCLINATION": "inclination_deg", "APOGEE": "altitude_km", "PERIGEE": "altitude_perigee_km", "RCS_SIZE": "rcs_size",
}
SATCAT = "NORAD_CAT_ID string, OBJECT_ID string, OBJECT_NAME string, OBJECT_TYPE string, OPS_STATUS string, COUNTRY string, LAUNCH_DATE string, APOGEE string, INCLINATION string"
MISSING = ["N/A", "", "0000-000"]


def read_csv(spark: SparkSession, path: str, schema: str = SATCAT) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def parse_csv(lines: DataFrame, column: str = "line", schema: str = SATCAT) -> DataFrame:
    """Rows of text lines, which an earlier step has read."""
    return lines.select(*[c for c in lines.columns if c != column], F.from_csv(column, schema).alias("r")).select("*", "r.*").drop("r")


def satellites(rows: DataFrame) -> DataFrame:
    """Catalogue rows with typed fields; rows without a positive id or with a number that isn't one are dropped."""
    number = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c).try_cast("double"))
    bad = lambda c: (F.length(F.trim(c)) > 0) & F.trim(c).try_cast("double").isNull()
    norad = F.trim("NORAD_CAT_ID").try_cast("long")
    kept = rows.where((norad > 0) & ~F.coalesce(bad(F.col("APOGEE")), F.lit(False)) & ~F.coalesce(bad(F.col("INCLINATION")), F.lit(False)))
    return kept.select(
        norad.alias("norad_id"), F.coalesce("OBJECT_ID", F.lit("")).alias("cospar_id"), F.coalesce("OBJECT_NAME", F.lit("")).alias("name"), F.coalesce("OBJECT_TYPE", F.lit("UNKNOWN")).alias("object_type"),
        F.col("LAUNCH_DATE").try_cast("date").alias("launch_date"), F.substring(F.coalesce("COUNTRY", F.lit("XX")), 1, 2).alias("country_code"),
        F.when(F.col("OPS_STATUS") == "+", "operational").otherwise("defunct").alias("status"), number(F.col("APOGEE")).alias("altitude_km"), number(F.col("INCLINATION")).alias("inclination"),
    )


def fields(raw: Column) -> Column:
    """A map of raw columns as a map of record fields; values that say "missing" are left out."""
    table = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    known = F.map_filter(raw, lambda k, v: F.map_contains_key(table, k) & ~F.coalesce(F.trim(v), F.lit("")).isin(MISSING))
    return F.transform_values(F.transform_keys(known, lambda k, v: F.element_at(table, k)), lambda k, v: F.trim(v))


def records(rows: DataFrame, raw: str, system: str) -> DataFrame:
    """Source records from a map column of raw values: id, class, fields, tags, and a content hash over the fields."""
    value = lambda k: F.trim(F.element_at(F.col(raw), k))
    kind = F.coalesce(value("OBJECT_TYPE"), F.lit("PAYLOAD"))
    kept = rows.where(F.length(value("NORAD_CAT_ID")) > 0)
    out = kept.select(
        F.concat(F.lit(f"{system}-"), value("NORAD_CAT_ID")).alias("source_id"), F.when(kind == "DEBRIS", "DEBRIS").otherwise("SATELLITE").alias("entity_class"),
        F.coalesce(value("SATNAME"), value("OBJECT_NAME"), F.concat(F.lit("OBJECT-"), value("NORAD_CAT_ID"))).alias("name"), fields(F.col(raw)).alias("fields"),
        F.array(F.lit(system), F.replace(F.lower(kind), F.lit(" "), F.lit("_"))).alias("tags"), F.nullif(value("COUNTRY"), F.lit("")).alias("launched_by"),
    )
    return out.withColumn("hash", content_hash("entity_class", "name", "fields"))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, maps in the order of their keys: equal contents, equal hashes."""
    parts = [F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) if c == "fields" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def id_ranges(first: int, last: int, size: int = 30_000) -> list[tuple[int, int]]:
    """Ranges of ids to fetch one by one, so that no request is too large."""
    return [(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]
