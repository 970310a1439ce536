"""Queries over filters (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zenithal.operators import filters
from zenithal.plans.registry import query
from zenithal.plans.tables import EVENTS_AS_OF

_now = lambda text: F.expr(f"TIMESTAMP_NTZ'{text}'")


@query("c1_optional_filters", "SELECT conjunction_id, pc, status FROM conjunctions WHERE NOT resolved AND pc >= 1e-4 AND status IN ('O', 'P')")
def c1(t):
    conditions = [*filters.equals(resolved=False, screening_org=None, status=["O", "P"]), F.col("pc") >= 1e-4, None]
    return t.conjunctions.where(filters.all_of(conditions)).select("conjunction_id", "pc", "status")


@query("c2_active_leo", "SELECT norad_id, name, perigee_km, apogee_km FROM catalog WHERE perigee_km >= 150 AND apogee_km <= 2000 AND tle_line1 IS NOT NULL AND tle_age_days <= 7")
def c2(t):
    return t.catalog.where("perigee_km >= 150 and apogee_km <= 2000 and tle_line1 is not null and tle_age_days <= 7").select("norad_id", "name", "perigee_km", "apogee_km")


@query("c3_substring_search", "SELECT norad_id, name FROM catalog WHERE name ILIKE '%7%' OR country ILIKE '%7%' OR norad_id = 7")
def c3(t):
    return t.catalog.where(filters.search("7", ["name", "country"], "norad_id")).select("norad_id", "name")


@query("c4_symmetric_key", "SELECT conjunction_id, primary_norad, secondary_norad FROM conjunctions WHERE primary_norad IN (SELECT norad_id FROM catalog WHERE perigee_km > 30000) OR secondary_norad IN (SELECT norad_id FROM catalog WHERE perigee_km > 30000)")
def c4(t):
    keys = t.catalog.where("perigee_km > 30000").select("norad_id")
    return filters.touches(keys, t.conjunctions, "norad_id", ("primary_norad", "secondary_norad"), "conjunction_id").select("conjunction_id", "primary_norad", "secondary_norad")


@query("c5_in_list", "SELECT conjunction_id, pc FROM conjunctions WHERE CASE WHEN pc >= 1e-3 THEN 'red' WHEN pc >= 1e-4 THEN 'yellow' END IN ('red', 'yellow') AND NOT resolved")
def c5(t):
    return t.conjunctions.where((F.col("pc") >= 1e-4) & ~F.col("resolved")).select("conjunction_id", "pc")


@query("c6_relative_window", "SELECT conjunction_id, tca, pc FROM conjunctions WHERE tca BETWEEN TIMESTAMP '1999-06-01' AND TIMESTAMP '1999-06-01' + INTERVAL 72 HOUR AND pc >= 1e-4")
def c6(t):
    return t.conjunctions.where(filters.within(F.col("tca"), _now("1999-06-01 00:00:00"), 72) & (F.col("pc") >= 1e-4)).select("conjunction_id", "tca", "pc")


@query("c7_time_range", "SELECT record_id, norad_id, rev_number, epoch FROM tle_records WHERE epoch BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-02-01'")
def c7(t):
    return t.tle_records.where(F.col("epoch").between(_now("1998-01-01 00:00:00"), _now("1998-02-01 00:00:00"))).select("record_id", "norad_id", "rev_number", "epoch")


@query("c8_array_containment", "SELECT doc_id, [lang, source] AS tags FROM documents WHERE list_contains([lang, source], 'en')")
def c8(t):
    tags = F.array("lang", "source")
    return t.documents.where(F.array_contains(tags, "en")).select("doc_id", tags.alias("tags"))


@query("c9_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM orbital_events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def c9(t):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return t.orbital_events.select("event_id", k.alias("k")).where("k >= 50")


@query("c10_point_in_time", "SELECT src, dst, type FROM edges WHERE (since IS NULL OR since <= 1995) AND (until IS NULL OR until >= 1995)")
def c10(t):
    return t.edges.where(filters.valid_at(F.lit(1995), F.col("since"), F.col("until"))).select("src", "dst", "type")


@query("c11_list_filters", "SELECT mission_id, name FROM missions WHERE lower(name) LIKE '%red%' AND status IN ('active', 'planned') AND budget_musd >= 950")
def c11(t):
    conditions = [filters.contains_text(F.col("name"), "RED"), *filters.equals(status=("active", "planned")), F.col("budget_musd") >= 950]
    return t.missions.where(filters.all_of(conditions)).select("mission_id", "name")


@query("c12_corpus_registry", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 10 <= 5 AND list_has_any([source, lang], ['de', (SELECT min(source) FROM documents)])")
def c12(t):
    first = t.documents.agg(F.min("source").alias("first"))
    rows = t.documents.select("doc_id", "lang", "source").join(F.broadcast(first))
    return rows.where((F.col("lang") == "en") & (F.col("doc_id") % 10 <= 5) & F.arrays_overlap(F.array("source", "lang"), F.array(F.lit("de"), F.col("first")))).select("doc_id")


@query("c13_payload_filter", "SELECT chunk_id FROM chunks WHERE agency IN ('en', 'fr') AND publication_year BETWEEN 2000 AND 2015 AND quality_score >= 0.5")
def c13(t):
    return t.chunks.where(filters.all_of([*filters.equals(agency=["en", "fr"]), F.col("publication_year").between(2000, 2015), F.col("quality_score") >= 0.5])).select("chunk_id")


@query("c14_class_constraint", """
WITH o(type, source, target) AS (VALUES ('REGISTERED_IN', ['Satellite'], ['Country']), ('OPERATED_BY', ['Satellite'], CAST([] AS VARCHAR[])), ('LOCATED_IN', ['City'], ['Region']))
SELECT e.src, e.dst, e.type, (len(o.source) = 0 OR list_contains(o.source, a.label)) AND (len(o.target) = 0 OR list_contains(o.target, b.label)) AS allowed
FROM edges e JOIN o ON o.type = e.type JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst""")
def c14(t):
    ontology = t.spark.createDataFrame([("REGISTERED_IN", ["Satellite"], ["Country"]), ("OPERATED_BY", ["Satellite"], []), ("LOCATED_IN", ["City"], ["Region"])], "type string, source array<string>, target array<string>")
    label = lambda end: t.nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    rows = t.edges.join(F.broadcast(ontology), "type").join(label("src"), "src").join(label("dst"), "dst")
    fits = lambda names, x: (F.size(names) == 0) | F.array_contains(names, F.col(x))
    return rows.select("src", "dst", "type", (fits("source", "src_label") & fits("target", "dst_label")).alias("allowed"))


@query("c15_relationship_errors", """
SELECT src, dst, type, concat_ws(';', CASE WHEN NOT regexp_matches(src, '^(sat|cty|org)-[0-9]+$') THEN 'invalid source' END, CASE WHEN NOT regexp_matches(dst, '^(cty|org)-[0-9]+$|^sat-[0-9]+$') THEN 'invalid target' END, CASE WHEN src = dst THEN 'self reference' END, CASE WHEN until < since THEN 'until before since' END, CASE WHEN confidence > 0.95 THEN 'confidence out of range' END) AS errors
FROM (SELECT src, dst, type, since, until, confidence FROM edges)""")
def c15(t):
    errors = filters.relationship_errors(*map(F.col, ("src", "dst", "since", "until")), F.col("confidence") + 0.05, "^(sat|cty|org)-[0-9]+$")
    return t.edges.select("src", "dst", "type", F.array_join(errors, ";").alias("errors"))


@query("c16_chunk_quality", r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 0.75e0) AS tokens FROM documents)
SELECT doc_id, length(t) > 0 AND tokens >= 80 AND length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) <= 0.15 * length(t) AND length(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 0.4 * length(t) AND len(regexp_extract_all(t, '(?m)^\[[0-9]+\]')) <= 3 AS good FROM d""")
def c16(t):
    from zenithal.functions.text import token_estimate

    return t.documents.select("doc_id", filters.good_chunk(F.col("text"), token_estimate(F.col("text"))).alias("good"))


@query("c17_predicted_conjunctions", "SELECT conjunction_id, pc, tca FROM conjunctions WHERE (primary_norad IN (SELECT norad_id FROM catalog WHERE status = 'active') OR secondary_norad IN (SELECT norad_id FROM catalog WHERE status = 'active')) AND pc >= 1e-3 ORDER BY pc DESC, tca, conjunction_id LIMIT 50")
def c17(t):
    active = t.catalog.where("status = 'active'").select("norad_id")
    found = filters.touches(active, t.conjunctions.where("pc >= 1e-3"), "norad_id", ("primary_norad", "secondary_norad"), "conjunction_id")
    return found.orderBy(F.desc("pc"), "tca", "conjunction_id").limit(50).select("conjunction_id", "pc", "tca")


@query("c18_live_states", "SELECT norad_id, x, y, z FROM states WHERE sqrt(x*x + y*y + z*z) - 6378.137e0 BETWEEN 2000 AND 35000")
def c18(t):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return t.states.where((r - 6378.137).between(2000, 35000)).select("norad_id", "x", "y", "z")
