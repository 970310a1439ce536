"""Queries over windows (W), order and pages (S), and sets (U)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.operators import joins, ordered
from zenithal.plans.registry import query
from zenithal.queries.e_aggregates import _cells


@query("w1_latest_per_key", "SELECT norad_id, epoch, element_set_num, rev_number, record_id FROM (SELECT *, row_number() OVER (PARTITION BY norad_id ORDER BY epoch DESC, element_set_num DESC, rev_number DESC, record_id DESC) AS k FROM tle_records) WHERE k = 1")
def w1(t):
    rows = t.tle_records.select("norad_id", "epoch", "element_set_num", "rev_number", "record_id")
    return joins.latest_per_key(rows, ["norad_id"], [F.col(c) for c in ("epoch", "element_set_num", "rev_number", "record_id")])


@query("w2_chunk_linking", "SELECT chunk_id, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY doc) AS total_chunks, lag(chunk_id) OVER w AS prev_chunk, lead(chunk_id) OVER w AS next_chunk FROM chunks WINDOW w AS (PARTITION BY doc ORDER BY chunk_id)")
def w2(t):
    w = W.partitionBy("doc").orderBy("chunk_id")
    return t.chunks.select("chunk_id", (F.row_number().over(w) - 1).cast("long").alias("chunk_index"), F.count(F.lit(1)).over(W.partitionBy("doc")).alias("total_chunks"), F.lag("chunk_id").over(w).alias("prev_chunk"), F.lead("chunk_id").over(w).alias("next_chunk"))


@query("w3_passes", """
WITH r AS (SELECT norad_id, event_id, event_time, value, value >= 20 AS up, lag(value >= 20, 1, false) OVER w AS was, lead(event_time) OVER w AS following FROM (SELECT * FROM orbital_events) WINDOW w AS (PARTITION BY norad_id ORDER BY event_time)),
g AS (SELECT *, sum(CASE WHEN up <> was THEN 1 ELSE 0 END) OVER (PARTITION BY norad_id ORDER BY event_time) AS run FROM r),
p AS (SELECT norad_id, run, min(event_time) AS aos, arg_max(coalesce(following, TIMESTAMP '2999-01-01'), event_time) AS los, max(value) AS max_elevation, arg_min(event_time, (-value, event_time)) AS tca FROM g WHERE up GROUP BY 1, 2)
SELECT norad_id, aos, los, tca, max_elevation, CAST(floor((epoch_us(los) - epoch_us(aos)) / 1e6) AS BIGINT) AS duration_s FROM p WHERE los < TIMESTAMP '2999-01-01'""")
def w3(t):
    return ordered.passes(t.orbital_events, ["norad_id"], "event_time", "value", 20.0)


@query("w4_share_of_max", "SELECT norad_id, round(perigee_km / max(perigee_km) OVER (), 9) AS share FROM catalog")
def w4(t):
    return ordered.share_of_max(t.catalog.select("norad_id", "perigee_km"), "perigee_km", "share").select("norad_id", F.round("share", 9).alias("share"))


@query("w5_primary_fact", "SELECT aqid, field, value, CAST(confidence AS DOUBLE) AS confidence, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY aqid, field ORDER BY confidence DESC, created DESC, fact_id DESC, value DESC) AS k FROM facts WHERE is_primary AND NOT superseded) WHERE k = 1")
def w5(t):
    live = t.facts.where("is_primary and not superseded").select("aqid", "field", "value", "confidence", "created", "fact_id")
    best = joins.latest_per_key(live, ["aqid", "field"], [F.col(c) for c in ("confidence", "created", "fact_id", "value")])
    return best.select("aqid", "field", "value", F.col("confidence").cast("double").alias("confidence"), "fact_id")


@query("w6_facts_by_field", "SELECT aqid, field, string_agg(CAST(fact_id AS VARCHAR) || '=' || CAST(value AS VARCHAR), ',' ORDER BY confidence DESC, created DESC, fact_id, value) AS facts FROM facts GROUP BY 1, 2")
def w6(t):
    """An entity has a handful of facts for a field, one per source, so the list of a group is short."""
    item = F.struct((-F.col("confidence")).alias("a"), (-F.unix_micros(F.col("created").cast("timestamp"))).alias("b"), F.col("fact_id"), "value")
    items = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.concat_ws("=", s["fact_id"], s["value"]))
    return t.facts.groupBy("aqid", "field").agg(F.array_join(items, ",").alias("facts"))


@query("w7_rank_fusion_scores", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents) SELECT lang, doc_id, rank, round(1 / (60e0 + rank), 9) AS score FROM r")
def w7(t):
    rank = (F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")) - 1).cast("long")
    return t.documents.select("lang", "doc_id", rank.alias("rank")).withColumn("score", F.round(1 / (F.lit(60.0) + F.col("rank")), 9))


@query("w8_sigma_anomaly", """
WITH s AS (SELECT norad_id, avg(value) AS m, stddev_pop(value) AS d FROM orbital_events GROUP BY 1), z AS (SELECT e.event_id, e.norad_id, (e.value - m) / d AS z FROM orbital_events e JOIN s USING (norad_id))
SELECT event_id, norad_id, round(z, 6) AS z, CASE WHEN abs(z) > 3 THEN 'severe' ELSE 'anomaly' END AS grade FROM z WHERE abs(z) >= 2.5""")
def w8(t):
    z = ordered.z_scores(t.orbital_events, "norad_id", "value").where(F.abs("z") >= 2.5)
    return z.select("event_id", "norad_id", F.round("z", 6).alias("z"), F.when(F.abs("z") > 3, "severe").otherwise("anomaly").alias("grade"))


@query("s1_pagination", "SELECT norad_id, name, (SELECT count(*) FROM catalog) AS total, 3 * 50 < (SELECT count(*) FROM catalog) AS has_next FROM catalog ORDER BY name, norad_id LIMIT 50 OFFSET 100")
def s1(t):
    return ordered.page(t.catalog.select("norad_id", "name"), [F.col("name"), F.col("norad_id")], 3, 50)


@query("s2_nulls_last", "SELECT mission_id, launch_year, row_number() OVER (ORDER BY launch_year DESC NULLS LAST, mission_id) AS place FROM missions ORDER BY launch_year DESC NULLS LAST, mission_id LIMIT 100")
def s2(t):
    top = t.missions.select("mission_id", "launch_year").orderBy(F.desc_nulls_last("launch_year"), "mission_id").limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("launch_year"), "mission_id")).cast("long"))


@query("s3_top_k", "SELECT conjunction_id, pc, miss_distance_km FROM conjunctions ORDER BY pc DESC, miss_distance_km, conjunction_id LIMIT 25")
def s3(t):
    return t.conjunctions.orderBy(F.desc("pc"), "miss_distance_km", "conjunction_id").limit(25).select("conjunction_id", "pc", "miss_distance_km")


@query("s4_priority_order", "SELECT event_id, severity, event_time FROM orbital_events ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, event_time, event_id LIMIT 100")
def s4(t):
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return t.orbital_events.orderBy(rank, "event_time", "event_id").limit(100).select("event_id", "severity", "event_time")


@query("s5_cursor", "WITH p AS (SELECT norad_id FROM catalog WHERE norad_id > 500 ORDER BY norad_id LIMIT 40) SELECT norad_id, CASE WHEN (SELECT count(*) FROM p) = 40 THEN (SELECT max(norad_id) FROM p) END AS next_cursor FROM p")
def s5(t):
    rows = t.catalog.select("norad_id").where("norad_id > 500").orderBy("norad_id").limit(40)
    full = rows.agg(F.when(F.count(F.lit(1)) == 40, F.max("norad_id")).alias("next_cursor"))
    return rows.join(F.broadcast(full))


@query("s6_result_order", "SELECT conjunction_id, rank() OVER (ORDER BY pc DESC) AS place FROM conjunctions")
def s6(t):
    """Place by probability: see :func:`ordered.places`."""
    return ordered.places(t.conjunctions, "pc").select("conjunction_id", "place")


@query("s7_option_ranking", "SELECT mission_id FROM (SELECT mission_type, mission_id, row_number() OVER (PARTITION BY mission_type ORDER BY CASE WHEN status = 'active' AND satellite_count > 25 THEN 0 WHEN status = 'active' THEN 1 ELSE 2 END, budget_musd NULLS LAST, mission_id) AS k FROM missions) WHERE k = 1")
def s7(t):
    grade = F.when((F.col("status") == "active") & (F.col("satellite_count") > 25), 0).when(F.col("status") == "active", 1).otherwise(2)
    best = t.missions.groupBy("mission_type").agg(F.min(F.struct(grade.alias("g"), F.col("budget_musd").isNull().alias("n"), "budget_musd", "mission_id")).alias("m"))
    return best.select("m.mission_id")


@query("s8_best_model", "SELECT source, max_by(doc_id, (coalesce(n_chars, 0), -doc_id)) AS best FROM documents GROUP BY 1")
def s8(t):
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct(F.coalesce("n_chars", F.lit(0)), -F.col("doc_id"))).alias("best"))


@query("s9_timeline_order", "SELECT src, dst, type, since FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY since NULLS LAST, src, dst) AS k FROM edges) WHERE k <= 10")
def s9(t):
    w = W.partitionBy("type").orderBy(F.asc_nulls_last("since"), "src", "dst")
    return t.edges.withColumn("k", F.row_number().over(w)).where("k <= 10").select("src", "dst", "type", "since")


@query("u1_union", "SELECT src FROM edges WHERE type = 'OPERATED_BY' UNION SELECT dst FROM edges WHERE type = 'SUBSIDIARY_OF'")
def u1(t):
    return t.edges.where("type = 'OPERATED_BY'").select("src").union(t.edges.where("type = 'SUBSIDIARY_OF'").select("dst")).distinct()


@query("u2_distinct_endpoints", "SELECT DISTINCT b.dst FROM edges a JOIN edges b ON b.src = a.dst")
def u2(t):
    middle = t.edges.select(F.col("dst").alias("src")).distinct()
    return t.edges.join(middle, "src", "left_semi").select("dst").distinct()


@query("u3_unordered_pairs", "SELECT DISTINCT least(primary_norad, secondary_norad) AS lo, greatest(primary_norad, secondary_norad) AS hi FROM conjunctions")
def u3(t):
    return t.conjunctions.select(F.least("primary_norad", "secondary_norad").alias("lo"), F.greatest("primary_norad", "secondary_norad").alias("hi")).distinct()


@query("u4_last_wins", "SELECT norad_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY norad_id ORDER BY event_time DESC, event_id DESC) AS k FROM orbital_events) WHERE k = 1")
def u4(t):
    return joins.latest_per_key(t.orbital_events.select("norad_id", "event_id", "value", "event_time"), ["norad_id"], [F.col("event_time"), F.col("event_id")]).drop("event_time")


@query("u5_fingerprint_dedup", "SELECT substr(sha256(lang || '|' || text), 1, 16) AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def u5(t):
    return t.documents.groupBy(F.substring(F.sha2(F.concat_ws("|", "lang", "text"), 256), 1, 16).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("u6_node_dedup", "SELECT id, min(label) AS label, count(*) AS seen FROM (SELECT src AS id, 'edge' AS label FROM edges UNION ALL SELECT id, label FROM nodes) GROUP BY 1")
def u6(t):
    both = t.edges.select(F.col("src").alias("id"), F.lit("edge").alias("label")).unionByName(t.nodes.select("id", "label"))
    return both.groupBy("id").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("seen"))


@query("u7_state_reducers", """
SELECT conv_id, string_agg(role || CAST(turn AS VARCHAR), ',' ORDER BY turn) AS messages, arg_max(role, turn) AS last_role, arg_max(length(text), turn) FILTER (role = 'user') AS user_chars FROM conversations GROUP BY 1""")
def u7(t):
    """Lists are appended in order, maps merged with the later turn winning, scalars keep the last value that is set.
    A conversation is a short list of turns."""
    ordered_turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("x"))))
    return t.conversations.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered_turns, lambda s: s["x"]), ",").alias("messages"), F.max_by("role", "turn").alias("last_role"),
        F.max(F.when(F.col("role") == "user", F.struct("turn", F.length("text").cast("long").alias("n"))))["n"].alias("user_chars"),
    )
