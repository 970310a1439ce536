"""Queries over ingestion and provenance (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zenithal.operators import ingest, joins
from zenithal.plans.registry import query

_RES = "CASE WHEN CAST({0} AS DECIMAL(12, 6)) - CAST({1} AS DECIMAL(12, 6)) > 0.15 THEN 'override' WHEN CAST({0} AS DECIMAL(12, 6)) - CAST({1} AS DECIMAL(12, 6)) < -0.15 THEN 'reject' ELSE 'dispute' END"
_PRIMARY = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aqid, field ORDER BY confidence DESC, created DESC, fact_id DESC, value DESC) AS k FROM facts WHERE is_primary AND NOT superseded) WHERE k = 1)"
_INCOMING = "i AS (SELECT aqid, field, CASE fact_id % 3 WHEN 0 THEN value ELSE value * 1.0005e0 + (fact_id % 2) END AS value, CAST(0.75 + (fact_id % 5) / 10.0 AS DECIMAL(6, 3)) AS confidence, fact_id + 1000000 AS fact_id FROM facts WHERE superseded)"
_FOUND = f"""{_PRIMARY}, {_INCOMING},
c AS (SELECT i.*, p.value AS old_value, p.confidence AS old_confidence, p.fact_id AS old_fact_id, {_RES.format('i.confidence', 'p.confidence')} AS resolution FROM i JOIN p ON p.aqid = i.aqid AND p.field = i.field WHERE i.value <> p.value AND abs(p.value - i.value) / greatest(abs(p.value), 1e-9) >= 0.001)"""


def _incoming(t):
    f = F.col("fact_id")
    value = F.when(f % 3 == 0, F.col("value")).otherwise(F.col("value") * 1.0005 + f % 2)
    return t.facts.where("superseded").select("aqid", "field", value.alias("value"), (0.75 + f % 5 / 10.0).cast("decimal(6,3)").alias("confidence"), (f + 1_000_000).alias("fact_id"))


@query("k1_normalise_records", """
SELECT p_partkey, 'AQID-' || CASE p_partkey % 3 WHEN 0 THEN 'SATELLITE' ELSE 'COMPANY' END || '-' || trim(regexp_replace(upper(p_name || ' ' || CAST(p_partkey AS VARCHAR)), '[^A-Z0-9]+', '-', 'g'), '-') AS aqid, greatest((p_partkey % 10) / 10e0, CASE p_partkey % 3 WHEN 0 THEN 0.95e0 ELSE 0.5e0 END) AS confidence, '' AS warnings FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT p_partkey, NULL, greatest((p_partkey % 10) / 10e0, 0.5e0), 'unknown type' FROM part WHERE p_partkey % 3 = 2""")
def k1(t):
    i = F.col("p_partkey")
    raw = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("name"), (i % 10 / 10.0).alias("confidence"), F.when(i % 3 == 0, "Satellite").when(i % 3 == 1, "startup").otherwise("thing").alias("raw_type"))
    return ingest.normalise(raw, F.when(i % 3 == 0, 2).otherwise(6)).select("p_partkey", "aqid", "confidence", F.array_join("warnings", ";").alias("warnings"))


@query("k2_map_contradictions", """
SELECT c_custkey, 'segment' AS field, c_mktsegment AS before, 'OTHER' AS after FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'OTHER' UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 25 AS VARCHAR) FROM customer WHERE c_nationkey <> c_custkey % 25""")
def k2(t):
    i = F.col("c_custkey")
    old = t.customer.select("c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("name"), F.col("c_name")).alias("m"))
    new = t.customer.select("c_custkey", F.create_map(F.lit("segment"), F.when(i % 2 == 0, "OTHER").otherwise(F.col("c_mktsegment")), F.lit("nation"), (i % 25).cast("string"), F.lit("extra"), F.lit("x")).alias("m"))
    return ingest.map_differences(old, new, "c_custkey", "m")


@query("k3_resolution_by_confidence", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_RES.format('1 - l_discount', '0.95 - l_tax')} AS resolution FROM lineitem")
def k3(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ingest.resolution(1 - F.col("l_discount"), 0.95 - F.col("l_tax")).alias("resolution"))


@query("k4_fact_contradictions", f"WITH {_FOUND} SELECT aqid, field, fact_id, round(value, 6) AS value, old_fact_id, old_value, resolution, CASE resolution WHEN 'dispute' THEN 'pending_review' ELSE 'auto_resolved' END AS status FROM c")
def k4(t):
    found = ingest.contradictions(_incoming(t), t.facts)
    return found.select("aqid", "field", "fact_id", F.round("value", 6).alias("value"), "old_fact_id", "old_value", "resolution", "status")


@query("k5_review_queue", f"WITH {_FOUND} SELECT aqid, field, fact_id, 'medium' AS priority, round(value - old_value, 6) AS gap FROM c WHERE resolution = 'dispute'")
def k5(t):
    found = ingest.contradictions(_incoming(t), t.facts).where("status = 'pending_review'")
    return found.select("aqid", "field", "fact_id", "priority", F.round(F.col("value") - F.col("old_value"), 6).alias("gap"))


@query("k5_supersede", f"WITH {_FOUND}, g AS (SELECT old_fact_id, aqid, field, max(fact_id) AS by_fact FROM c WHERE resolution = 'override' GROUP BY ALL) SELECT f.aqid, f.field, count(*) AS facts, count(g.by_fact) AS overridden, count(*) FILTER (f.is_primary AND g.by_fact IS NULL) AS primaries FROM facts f LEFT JOIN g ON g.old_fact_id = f.fact_id AND g.aqid = f.aqid AND g.field = f.field GROUP BY 1, 2")
def k5_supersede(t):
    after = ingest.apply_resolutions(t.facts, ingest.contradictions(_incoming(t), t.facts))
    return after.groupBy("aqid", "field").agg(F.count(F.lit(1)).alias("facts"), F.count("superseded_by").alias("overridden"), F.count_if("is_primary").alias("primaries"))


@query("k6_human_resolution", f"WITH {_FOUND} SELECT aqid, field, fact_id, CASE WHEN fact_id % 2 = 0 THEN 'accepted' ELSE 'kept' END AS decision, CASE WHEN fact_id % 2 = 0 THEN round(value, 6) ELSE old_value END AS value FROM c WHERE resolution = 'dispute'")
def k6(t):
    open_reviews = ingest.contradictions(_incoming(t), t.facts).where("status = 'pending_review'")
    accept = F.col("fact_id") % 2 == 0
    return open_reviews.select("aqid", "field", "fact_id", F.when(accept, "accepted").otherwise("kept").alias("decision"), F.when(accept, F.round("value", 6)).otherwise(F.col("old_value")).alias("value"))


@query("k7_version_snapshot", """SELECT s_suppkey, 'v' || CAST(1 + s_suppkey % 3 AS VARCHAR) AS version, '{"s_name":"' || s_name || '","s_nationkey":' || CAST(s_nationkey AS VARCHAR) || ',"s_suppkey":' || CAST(s_suppkey AS VARCHAR) || '}' AS state FROM supplier""")
def k7(t):
    return ingest.snapshot(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey", F.concat(F.lit("v"), 1 + F.col("s_suppkey") % 3))


@query("k8_fact_history", "SELECT fact_id, source, value, created FROM facts WHERE aqid = 7 AND field = 2 ORDER BY created DESC, fact_id LIMIT 50")
def k8(t):
    return t.facts.where("aqid = 7 and field = 2").orderBy(F.desc("created"), "fact_id").limit(50).select("fact_id", "source", "value", "created")


@query("k9_relationship_resolution", """
WITH r AS (SELECT l_partkey % 30 AS a, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS b, CASE l_linenumber % 3 WHEN 0 THEN 'operated_by' WHEN 1 THEN 'subsidiary_of' END AS type, l_discount AS c FROM lineitem)
SELECT 'AQID-COMPANY-SUPPLIER-' || substr(b, 10) AS dst, 'AQID-COMPANY-FIRM-' || CAST(a AS VARCHAR) AS src, upper(type) AS type, count(*) AS seen, max(c) AS confidence FROM r WHERE type IS NOT NULL GROUP BY ALL""")
def k9(t):
    from zenithal.functions.ids import aqid
    from zenithal.functions.text import relationship_type

    i = F.col("l_linenumber") % 3
    raw = F.when(i == 0, " Operated By").when(i == 1, "subsidiary of").otherwise("likes")
    rows = t.lineitem.select(
        aqid(F.lit("COMPANY"), F.concat(F.lit("firm "), F.col("l_partkey") % 30)).alias("src"), aqid(F.lit("COMPANY"), F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))).alias("dst"),
        relationship_type(raw, ["OPERATED_BY", "SUBSIDIARY_OF", "LOCATED_IN"]).alias("type"), F.col("l_discount").alias("confidence"),
    )
    return rows.where("type is not null and src <> dst").groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("seen"), F.max("confidence").alias("confidence"))


@query("k10_schedule_due", "SELECT event_type, max(event_time) AS last_run, max(event_time) + to_hours(CASE event_type WHEN 'error' THEN 1 ELSE 48 END) <= TIMESTAMP '2024-01-31 12:00:00' AS due FROM orbital_events GROUP BY 1")
def k10(t):
    last = t.orbital_events.groupBy("event_type").agg(F.max("event_time").alias("last_run"))
    hours = F.when(F.col("event_type") == "error", 1).otherwise(48)
    plan = last.withColumn("next_run", F.timestamp_add("HOUR", hours, F.col("last_run"))).withColumn("enabled", F.lit(True))
    now = ingest.due(plan, F.expr("TIMESTAMP_NTZ'2024-01-31 12:00:00'")).select("event_type", F.lit(True).alias("is_due"))
    return plan.join(now, "event_type", "left").select("event_type", "last_run", F.coalesce("is_due", F.lit(False)).alias("due"))


@query("k11_valuable_fields", "SELECT c_custkey, 'norad_id' AS field, CAST(c_custkey AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, 'altitude_km', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0")
def k11(t):
    m = F.create_map(F.lit("norad_id"), F.col("c_custkey").cast("string"), F.lit("altitude_km"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")), F.lit("name"), F.col("c_name"))
    return t.customer.select("c_custkey", F.explode(m).alias("field", "value")).where(F.col("field").isin(ingest.VALUABLE) & F.col("value").isNotNull())
