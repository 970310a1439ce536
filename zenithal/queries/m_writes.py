"""Queries over changes of tables (M)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from zenithal.functions import orbit
from zenithal.operators import chunks, joins, writes
from zenithal.plans.registry import query
from zenithal.plans.tables import AS_OF, EVENTS_AS_OF
from zenithal.session import shared_dir

RISK = "CASE WHEN pc >= 1e-3 THEN 'red' WHEN pc >= 1e-4 THEN 'yellow' WHEN pc >= 1e-5 THEN 'green' ELSE 'white' END"
_ts = lambda text: F.expr(f"TIMESTAMP_NTZ'{text}'")


@query("m1_upsert", """
WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS mass, 1 AS created FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal + 1 AS mass, 2 AS created FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(b.id, o.id) AS id, coalesce(b.name, o.name) AS name, coalesce(b.mass, o.mass) AS mass, CAST(coalesce(o.created, b.created) AS INTEGER) AS created FROM o FULL JOIN b ON o.id = b.id""")
def m1(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("mass"))
    old = base.where("id % 3 <> 0").withColumn("created", F.lit(1))
    batch = base.where("id % 2 = 0").select("id", F.upper("name").alias("name"), (F.col("mass") + 1).alias("mass"), F.lit(2).alias("created"))
    return writes.upsert(old, batch, ["id"], keep=["created"])


@query("m2_partial_upsert", """
WITH o AS (SELECT conjunction_id, pc, miss_distance_km, screening_org FROM conjunctions WHERE conjunction_id % 4 <> 3), b AS (SELECT conjunction_id, CASE WHEN conjunction_id % 5 <> 0 THEN pc / 2 END AS pc, miss_distance_km + 1 AS miss_distance_km, 'x' AS screening_org FROM conjunctions WHERE conjunction_id % 2 = 1)
SELECT coalesce(o.conjunction_id, b.conjunction_id) AS conjunction_id, coalesce(b.pc, o.pc) AS pc, coalesce(b.miss_distance_km, o.miss_distance_km) AS miss_distance_km, CASE WHEN o.conjunction_id IS NULL THEN b.screening_org ELSE o.screening_org END AS screening_org FROM o FULL JOIN b ON o.conjunction_id = b.conjunction_id""")
def m2(t):
    base = t.conjunctions.select("conjunction_id", "pc", "miss_distance_km", "screening_org")
    i = F.col("conjunction_id")
    batch = base.where(i % 2 == 1).select("conjunction_id", F.when(i % 5 != 0, F.col("pc") / 2).alias("pc"), (F.col("miss_distance_km") + 1).alias("miss_distance_km"), F.lit("x").alias("screening_org"))
    return writes.upsert(base.where(i % 4 != 3), batch, ["conjunction_id"], only=["pc", "miss_distance_km"])


@query("m3_insert_or_skip", "WITH k AS (SELECT DISTINCT norad_id, epoch, element_set_num, epoch < TIMESTAMP '1998-01-01' AS old FROM tle_records) SELECT norad_id, epoch, element_set_num FROM k WHERE NOT old AND element_set_num <= 4")
def m3(t):
    keys = ["norad_id", "epoch", "element_set_num"]
    old = t.tle_records.where(F.col("epoch") < _ts("1998-01-01 00:00:00"))
    batch = t.tle_records.where("element_set_num <= 4")
    return writes.insert_new(old, batch, keys).select(*keys)


@query("m4_cache_update", "WITH l AS (SELECT norad_id, max((epoch, element_set_num, rev_number)) AS m FROM tle_records GROUP BY 1) SELECT s.s_suppkey, s.s_name, m[1] AS epoch, m[2] AS element_set_num FROM supplier s LEFT JOIN l ON l.norad_id = s.s_suppkey")
def m4(t):
    last = joins.latest_per_key(t.tle_records.select("norad_id", "epoch", "element_set_num", "rev_number"), ["norad_id"], [F.col(c) for c in ("epoch", "element_set_num", "rev_number")])
    return t.supplier.join(last, F.col("s_suppkey") == F.col("norad_id"), "left").select("s_suppkey", "s_name", "epoch", "element_set_num")


@query("m5_resolve", "SELECT conjunction_id, resolved OR (primary_norad % 10 = 3 AND pc < 1e-3) AS resolved, CASE WHEN primary_norad % 10 = 3 AND pc < 1e-3 THEN 'monitor' ELSE status END AS status FROM conjunctions")
def m5(t):
    hit = (F.col("primary_norad") % 10 == 3) & (F.col("pc") < 1e-3)
    return writes.change(t.conjunctions, hit, resolved=F.lit(True), status=F.lit("monitor")).select("conjunction_id", "resolved", "status")


@query("m6_json_merge", "SELECT event_id, CAST(json_merge_patch(props, '{\"n\": ' || CAST(event_id % 5 AS VARCHAR) || '}') AS VARCHAR) AS props FROM (SELECT event_id, '{\"k\": ' || json_extract_string(props, '$.k') || '}' AS props FROM orbital_events)")
def m6(t):
    """Old and new maps merged, the new one winning."""
    old = F.from_json("props", "map<string,int>")
    new = F.create_map(F.lit("n"), (F.col("event_id") % 5).cast("int"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return t.orbital_events.select("event_id", F.to_json(merged).alias("props"))


@query("m7_array_append", "SELECT doc_id, array_to_string(list_append([lang, source], 'reviewed'), ',') AS tags FROM documents")
def m7(t):
    return t.documents.select("doc_id", F.array_join(F.array_append(F.array("lang", "source"), "reviewed"), ",").alias("tags"))


@query("m8_edge_merge", """
WITH o AS (SELECT src, dst, type, confidence, 3 AS version FROM edges WHERE type <> 'SUBSIDIARY_OF'), b AS (SELECT src, dst, type, 0.99e0 AS confidence FROM edges WHERE type IN ('SUBSIDIARY_OF', 'LOCATED_IN'))
SELECT coalesce(o.src, b.src) AS src, coalesce(o.dst, b.dst) AS dst, coalesce(o.type, b.type) AS type, coalesce(b.confidence, o.confidence) AS confidence, CAST(CASE WHEN o.src IS NULL THEN 1 WHEN b.src IS NULL THEN 3 ELSE 4 END AS INTEGER) AS version FROM o FULL JOIN b ON o.src = b.src AND o.dst = b.dst AND o.type = b.type""")
def m8(t):
    old = t.edges.where("type <> 'SUBSIDIARY_OF'").select("src", "dst", "type", "confidence", F.lit(3).alias("version"))
    return writes.merge_edges(old, t.edges.where("type in ('SUBSIDIARY_OF', 'LOCATED_IN')").select("src", "dst", "type", F.lit(0.99).alias("confidence")))


@query("m9_conditional_edges", "SELECT 'sat-' || CAST(c.secondary_norad AS VARCHAR) AS src, 'cj-' || CAST(c.conjunction_id AS VARCHAR) AS dst FROM conjunctions c WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.id = 'sat-' || CAST(c.secondary_norad AS VARCHAR))")
def m9(t):
    wanted = t.conjunctions.select(F.concat(F.lit("sat-"), "secondary_norad").alias("src"), F.concat(F.lit("cj-"), "conjunction_id").alias("dst"))
    return wanted.join(t.nodes.select(F.col("id").alias("src")), "src", "left_semi")


@query("m10_soft_delete", "SELECT src, dst, type, until IS NULL OR until >= 2010 AS is_current FROM edges WHERE type = 'REGISTERED_IN'")
def m10(t):
    rows = t.edges.where("type = 'REGISTERED_IN'").withColumn("is_current", F.lit(True))
    return writes.change(rows, F.col("until") < 2010, is_current=F.lit(False)).select("src", "dst", "type", "is_current")


@query("m11_ttl_delete", f"SELECT event_id FROM orbital_events WHERE event_time >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY")
def m11(t):
    return t.orbital_events.where(F.col("event_time") >= F.expr(f"TIMESTAMP_NTZ'{EVENTS_AS_OF}' - INTERVAL 7 DAYS")).select("event_id")


@query("m12_retention", f"SELECT strftime(date_trunc('month', epoch), '%Y-%m') AS month, count(*) AS n, epoch_us(date_trunc('month', min(epoch))) < epoch_us(TIMESTAMP '{AS_OF}' - INTERVAL 730 DAY) AS dropped FROM tle_records GROUP BY 1")
def m12(t):
    """Whole months older than two years go: a partition each."""
    old = F.date_trunc("month", F.min("epoch")) < F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 730 DAYS")
    return t.tle_records.groupBy(F.date_format("epoch", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), old.alias("dropped"))


@query("m12_time_chunks", f"""
WITH r AS (SELECT norad_id, epoch, element_set_num, rev_number, record_id, bstar, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(epoch AS DATE)) / 30) AS INTEGER) AS chunk FROM tle_records),
n AS (SELECT norad_id, epoch, element_set_num, rev_number, record_id, max(bstar) + 1000 AS bstar, chunk FROM r WHERE rev_number % 50 = 0 GROUP BY ALL)
SELECT *, bstar >= 1000 AS changed FROM (SELECT * FROM n UNION ALL SELECT * FROM r ANTI JOIN n USING (norad_id, epoch, element_set_num, rev_number, record_id)) WHERE (chunk + 1) * 30 > date_diff('day', DATE '1970-01-01', DATE '{AS_OF[:10]}' - INTERVAL 730 DAY)""")
def m12_chunks(t):
    """Chunks of 30 days: two loads, changes that rewrite their own chunks, compaction of what is older than 30 days, and two years kept."""
    path, now = shared_dir(t.spark, "chunks"), datetime.datetime.fromisoformat(AS_OF)
    table = chunks.TimeChunks(t.spark, path, "epoch", 30)
    rows = t.tle_records.select("norad_id", "epoch", "element_set_num", "rev_number", "record_id", "bstar")
    table.append(rows.where("record_id % 2 = 0"))
    table.append(rows.where("record_id % 2 = 1"))
    keys = ["norad_id", "epoch", "element_set_num", "rev_number", "record_id"]
    table.upsert(rows.where("rev_number % 50 = 0").groupBy(*keys).agg((F.max("bstar") + 1000).alias("bstar")), keys)
    table.compact(now - datetime.timedelta(days=30))
    table.retain(now - datetime.timedelta(days=730))
    return table.read().select(*keys, "bstar", "chunk", (F.col("bstar") >= 1000).alias("changed"))


@query("m13_transitions", "SELECT mission_id, status AS before, CASE WHEN satellite_count > 40 THEN 'active' ELSE status END AS after FROM missions WHERE satellite_count > 40 AND status <> 'active'")
def m13(t):
    old = t.missions.select("mission_id", "status", "satellite_count")
    return writes.transitions(old, writes.change(old, F.col("satellite_count") > 40, status=F.lit("active")), "mission_id", "status")


@query("m14_auto_publish", "SELECT mission_id, CASE WHEN status = 'planned' AND budget_musd >= 1000 AND mission_type <> 'PROMO' THEN 'published' ELSE status END AS status FROM missions")
def m14(t):
    ready = (F.col("status") == "planned") & (F.col("budget_musd") >= 1000) & (F.col("mission_type") != "PROMO")
    return writes.change(t.missions, ready, status=F.lit("published")).select("mission_id", "status")


@query("m15_persist_screening", f"""
SELECT conjunction_id, {RISK} AS risk, 'conjunction' AS kind FROM conjunctions WHERE pc >= 1e-5 UNION ALL SELECT conjunction_id, {RISK}, 'event' FROM conjunctions WHERE pc >= 1e-4""")
def m15(t):
    """White ones are not kept; red and yellow ones make events, too."""
    rows = t.conjunctions.select("conjunction_id", orbit.risk_band(F.col("pc")).alias("risk")).where("risk <> 'white'")
    kinds = F.when(F.col("risk").isin("red", "yellow"), F.array(F.lit("conjunction"), F.lit("event"))).otherwise(F.array(F.lit("conjunction")))
    return rows.withColumn("kind", F.explode(kinds))


@query("m16_job_metrics", "SELECT event_type AS job, count(*) AS runs, max(event_time) AS last_run, arg_max(value, (event_time, event_id)) AS last_value FROM orbital_events GROUP BY 1")
def m16(t):
    return t.orbital_events.groupBy(F.col("event_type").alias("job")).agg(F.count(F.lit(1)).alias("runs"), F.max("event_time").alias("last_run"), F.max_by("value", F.struct("event_time", "event_id")).alias("last_value"))


@query("m17_catalog_sync", """
WITH b AS (SELECT norad_id, max(epoch) AS epoch, count(*) AS n, count(DISTINCT (epoch, element_set_num)) AS keys FROM tle_records GROUP BY 1)
SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS received, CAST(sum(keys) AS BIGINT) AS inserted, CAST(sum(n - keys) AS BIGINT) AS skipped, count(*) FILTER (epoch < TIMESTAMP '2001-10-25') AS stale, CASE WHEN sum(n - keys) > 0 THEN 'partial' ELSE 'complete' END AS status FROM b""")
def m17(t):
    """Ingest, skip what is known, update the catalogue, count what is stale: the report of a synchronisation."""
    per = t.tle_records.groupBy("norad_id", "epoch", "element_set_num").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("norad_id").agg(F.max("epoch").alias("epoch"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
    skipped = F.sum(F.col("n") - F.col("keys"))
    return per.agg(
        F.count(F.lit(1)).alias("objects"), F.sum("n").alias("received"), F.sum("keys").alias("inserted"), skipped.alias("skipped"),
        F.count_if(F.col("epoch") < _ts("2001-10-25 00:00:00")).alias("stale"), F.when(skipped > 0, "partial").otherwise("complete").alias("status"),
    )


@query("m18_graph_population", f"""
SELECT 'sat-' || CAST(norad_id AS VARCHAR) AS src, lower(mission_type) AS dst, 'HAS_MISSION' AS type FROM catalog UNION ALL
SELECT 'sat-' || CAST(primary_norad AS VARCHAR), 'cj-' || CAST(conjunction_id AS VARCHAR), 'INVOLVED_' || upper({RISK}) FROM conjunctions WHERE pc >= 1e-4""")
def m18(t):
    """Relations projected to nodes and edges."""
    missions = t.catalog.select(F.concat(F.lit("sat-"), "norad_id").alias("src"), F.lower("mission_type").alias("dst"), F.lit("HAS_MISSION").alias("type"))
    risk = F.upper(orbit.risk_band(F.col("pc")))
    events = t.conjunctions.where("pc >= 1e-4").select(F.concat(F.lit("sat-"), "primary_norad").alias("src"), F.concat(F.lit("cj-"), "conjunction_id").alias("dst"), F.concat(F.lit("INVOLVED_"), risk).alias("type"))
    return missions.unionByName(events)
