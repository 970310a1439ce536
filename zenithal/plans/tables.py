"""Input tables, and proxy relations of the space domain that are derived from them.

The test tables hold no satellites, so each relation of the domain (catalogue, element sets, conjunctions, graph, facts) is
a projection of one of them by integer arithmetic on keys. The text of a projection is plain SQL that any engine runs alike:
Spark gets it through ``spark.sql`` with the tables as parameters, an oracle as a common table expression.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The instants that stand for "now" over orders and line items, and over events.
AS_OF, EVENTS_AS_OF = "2001-08-01 00:00:00", "2024-01-31 00:00:00"

PROXIES = {
    "orbits": """
        SELECT c_custkey AS norad_id,
               CAST(CASE c_custkey % 10 WHEN 0 THEN 35586 + c_custkey % 400 WHEN 1 THEN 19000 + (c_custkey * 7) % 2000 WHEN 2 THEN 180 + c_custkey % 300 ELSE 150 + (c_custkey * 37) % 1900 END AS DOUBLE) AS perigee_km,
               CAST(CASE c_custkey % 10 WHEN 0 THEN c_custkey % 30 WHEN 1 THEN 50 + c_custkey % 90 WHEN 2 THEN CASE WHEN c_custkey % 4 = 0 THEN 39000 ELSE 35000 + c_custkey % 300 END ELSE (c_custkey * 13) % 400 END AS DOUBLE) AS spread_km,
               CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 4 WHEN c_custkey % 10 = 2 THEN 60 + c_custkey % 7 WHEN c_custkey % 5 = 3 THEN 95 + c_custkey % 7 ELSE (c_custkey * 7) % 180 END AS DOUBLE) AS inclination_deg
        FROM {customer}""",
    "catalog": """
        SELECT o.norad_id, c.c_name AS name, n.n_name AS country, c.c_mktsegment AS mission_type, c.c_acctbal AS mass_kg,
               CASE c.c_custkey % 4 WHEN 0 THEN 'PAYLOAD' WHEN 1 THEN 'debris' WHEN 2 THEN 'R/B' ELSE 'Satellite' END AS object_type,
               o.perigee_km, o.perigee_km + o.spread_km AS apogee_km, o.inclination_deg,
               o.perigee_km + o.spread_km / 2 + 6378.137e0 AS semi_major_axis_km, o.spread_km / (2 * o.perigee_km + o.spread_km + 12756.274e0) AS eccentricity,
               CASE c.c_custkey % 6 WHEN 0 THEN 'leo' WHEN 3 THEN 'Geo' END AS stored_regime,
               CAST(c.c_custkey % 15 AS DOUBLE) AS tle_age_days, CASE WHEN c.c_custkey % 11 <> 0 THEN 'L1' END AS tle_line1,
               CASE WHEN c.c_custkey % 9 = 0 THEN 'decayed' WHEN c.c_custkey % 9 = 1 THEN 'inactive' ELSE 'active' END AS status
        FROM {orbits} o JOIN {customer} c ON c.c_custkey = o.norad_id JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "tle_records": """
        SELECT l_suppkey AS norad_id, l_shipdate AS epoch, l_linenumber AS element_set_num, l_orderkey AS rev_number,
               CASE l_returnflag WHEN 'A' THEN 'space-track' WHEN 'N' THEN 'celestrak' ELSE 'manual' END AS source, l_partkey AS record_id, l_quantity AS bstar
        FROM {lineitem}""",
    "conjunctions": """
        SELECT o_orderkey AS conjunction_id, o_custkey AS primary_norad, (o_custkey * 7 + 11) % 1500 AS secondary_norad, o_orderdate AS tca,
               o_totalprice / 100000 + 1.2345678e-8 AS miss_distance_km, CAST(5 + o_orderkey % 11 AS DOUBLE) AS relative_velocity_kms,
               CASE o_orderkey % 6 WHEN 0 THEN 2e-2 WHEN 1 THEN 1e-3 WHEN 2 THEN 5e-4 WHEN 3 THEN 1e-4 WHEN 4 THEN 1e-5 ELSE 3e-7 END AS pc,
               o_orderstatus = 'F' AS resolved, o_orderkey % 3 = 0 AS maneuver_required, o_orderpriority AS screening_org, o_orderstatus AS status
        FROM {orders}""",
    "orbital_events": """
        SELECT event_id, user_id AS norad_id, event_type, ts AS event_time, value, props,
               CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS severity
        FROM {events}""",
    "missions": """
        SELECT p_partkey AS mission_id, p_name AS name, p_type AS mission_type, p_brand AS agency, CASE p_size % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'planned' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
               p_size AS satellite_count, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS budget_musd, CASE WHEN p_partkey % 7 <> 0 THEN 1960 + p_partkey % 60 END AS launch_year
        FROM {part}""",
    "nodes": """
        SELECT 'sat-' || CAST(c_custkey AS VARCHAR(20)) AS id, 'Satellite' AS label, c_name AS name FROM {customer}
        UNION ALL SELECT 'cty-' || CAST(n_nationkey AS VARCHAR(20)), 'Country', n_name FROM {nation}
        UNION ALL SELECT 'reg-' || CAST(r_regionkey AS VARCHAR(20)), 'Region', r_name FROM {region}
        UNION ALL SELECT 'org-' || CAST(s_suppkey AS VARCHAR(20)), 'Organization', s_name FROM {supplier}""",
    "edges": """
        SELECT 'sat-' || CAST(c_custkey AS VARCHAR(20)) AS src, 'cty-' || CAST(c_nationkey AS VARCHAR(20)) AS dst, 'REGISTERED_IN' AS type, CAST(1960 + c_custkey % 60 AS INT) AS since, CASE WHEN c_custkey % 3 = 0 THEN CAST(1990 + c_custkey % 40 AS INT) END AS until, 0.5e0 + (c_custkey % 50) / 100e0 AS confidence FROM {customer}
        UNION ALL SELECT 'cty-' || CAST(n_nationkey AS VARCHAR(20)), 'reg-' || CAST(n_regionkey AS VARCHAR(20)), 'LOCATED_IN', NULL, NULL, 1e0 FROM {nation}
        UNION ALL SELECT 'sat-' || CAST(c_custkey AS VARCHAR(20)), 'org-' || CAST(c_custkey % 100 AS VARCHAR(20)), 'OPERATED_BY', CAST(1970 + c_custkey % 50 AS INT), NULL, 0.9e0 FROM {customer}
        UNION ALL SELECT 'org-' || CAST(s_suppkey AS VARCHAR(20)), 'cty-' || CAST(s_nationkey AS VARCHAR(20)), 'HEADQUARTERED_IN', NULL, NULL, 0.8e0 FROM {supplier}
        UNION ALL SELECT 'org-' || CAST(s_suppkey AS VARCHAR(20)), 'org-' || CAST(s_suppkey - 1 - s_suppkey % 7 AS VARCHAR(20)), 'SUBSIDIARY_OF', CAST(1980 + s_suppkey % 40 AS INT), NULL, 0.7e0 FROM {supplier} WHERE s_suppkey - 1 - s_suppkey % 7 >= 0""",
    "participation": """
        SELECT 'sat-' || CAST(o_custkey AS VARCHAR(20)) AS src, 'cj-' || CAST(o_orderkey AS VARCHAR(20)) AS dst, 'PRIMARY_IN' AS type FROM {orders}
        UNION ALL SELECT 'sat-' || CAST((o_custkey * 7 + 11) % 1500 AS VARCHAR(20)), 'cj-' || CAST(o_orderkey AS VARCHAR(20)), 'SECONDARY_IN' FROM {orders}""",
    "lineage": """
        SELECT p_partkey AS src, p_partkey - (1 + p_partkey % 7) AS dst FROM {part} WHERE p_partkey - (1 + p_partkey % 7) >= 1""",
    "facts": """
        SELECT l_partkey AS aqid, l_linenumber AS field, l_quantity AS value, CAST(1 - l_discount AS DECIMAL(6, 3)) AS confidence, l_suppkey AS source, l_shipdate AS created, l_orderkey AS fact_id,
               l_returnflag = 'A' AS is_primary, l_returnflag = 'R' AS superseded
        FROM {lineitem}""",
    "points": """
        SELECT c_custkey AS id, CAST((c_custkey * 37) % 211 - 105 AS DOUBLE) AS x, CAST((c_custkey * 53) % 197 - 98 AS DOUBLE) AS y, CAST((c_custkey * 71) % 61 - 30 AS DOUBLE) AS z FROM {customer}""",
    "states": """
        SELECT c_custkey AS norad_id, 6378.137e0 + 100e0 + c_custkey % 1900 + (c_custkey % 7) * 5000e0 AS x, CAST((c_custkey * 17) % 3000 AS DOUBLE) - 1500e0 AS y, CAST((c_custkey * 29) % 4000 AS DOUBLE) - 2000e0 AS z,
               (c_custkey % 13) / 10e0 - 0.6e0 AS vx, 6.5e0 + (c_custkey % 17) / 10e0 AS vy, (c_custkey % 19) / 10e0 - 0.9e0 AS vz FROM {customer}""",
    "kp": """
        SELECT event_id, ts, CAST(event_id % 100 AS DOUBLE) / 10 AS kp, 65e0 + (event_id * 7) % 240 AS f107 FROM {events}""",
    "chunks": """
        SELECT d.doc_id AS chunk_id, d.doc_id % 97 AS doc, d.lang AS agency, d.source AS doc_type, CAST(1990 + d.doc_id % 35 AS INT) AS publication_year, d.text, d.n_chars AS text_length,
               (d.doc_id % 100) / 100e0 AS quality_score, 'section ' || CAST(d.doc_id % 5 AS VARCHAR(20)) AS section_title FROM {documents} d""",
    "tle_bodies": """
        SELECT s_suppkey AS set_id, s_name AS name, k,
               '1 ' || lpad(CAST(10000 + s_suppkey AS VARCHAR(20)), 5, '0') || 'U 24' || lpad(CAST(1 + s_suppkey % 99 AS VARCHAR(20)), 3, '0') || 'A   ' || CASE WHEN s_suppkey % 9 = 0 THEN '98' ELSE '24' END || lpad(CAST(1 + (s_suppkey * 11 + k) % 365 AS VARCHAR(20)), 3, '0') || '.' || lpad(CAST((s_suppkey * 1237 + k * 31) % 1000 AS VARCHAR(20)), 3, '0') || '00000  .0000' || lpad(CAST(s_suppkey % 1000 AS VARCHAR(20)), 4, '0') || '  00000-0 ' || CASE WHEN s_suppkey % 5 = 0 THEN '-' ELSE ' ' END || lpad(CAST(10000 + (s_suppkey * 77) % 90000 AS VARCHAR(20)), 5, '0') || '-4 0 ' || lpad(CAST(s_suppkey % 1000 AS VARCHAR(20)), 4, ' ') AS body1,
               '2 ' || lpad(CAST(CASE WHEN s_suppkey % 13 = 5 THEN 10001 ELSE 10000 END + s_suppkey AS VARCHAR(20)), 5, '0') || ' ' || lpad(CAST((s_suppkey * 7) % 190 AS VARCHAR(20)), 3, ' ') || '.5000 ' || lpad(CAST((s_suppkey * 17) % 360 AS VARCHAR(20)), 3, ' ') || '.2500 ' || lpad(CAST((s_suppkey * 3571) % 900000 AS VARCHAR(20)), 7, '0') || ' ' || lpad(CAST((s_suppkey * 29) % 360 AS VARCHAR(20)), 3, ' ') || '.1250 ' || lpad(CAST((s_suppkey * 31) % 360 AS VARCHAR(20)), 3, ' ') || '.7500 ' || lpad(CAST(1 + s_suppkey % 16 AS VARCHAR(20)), 2, ' ') || '.50000000' || lpad(CAST((s_suppkey * 13) % 99999 AS VARCHAR(20)), 5, ' ') AS body2
        FROM {supplier} CROSS JOIN (SELECT r_regionkey AS k FROM {region}) g""",
    "tle_sets": """
        SELECT set_id, k, name, body1 || CAST(((1 * (length(body1) - length(replace(body1, '1', ''))) + 2 * (length(body1) - length(replace(body1, '2', ''))) + 3 * (length(body1) - length(replace(body1, '3', ''))) + 4 * (length(body1) - length(replace(body1, '4', ''))) + 5 * (length(body1) - length(replace(body1, '5', ''))) + 6 * (length(body1) - length(replace(body1, '6', ''))) + 7 * (length(body1) - length(replace(body1, '7', ''))) + 8 * (length(body1) - length(replace(body1, '8', ''))) + 9 * (length(body1) - length(replace(body1, '9', ''))) + length(body1) - length(replace(body1, '-', ''))) + CASE WHEN set_id % 7 = 3 THEN 1 ELSE 0 END) % 10 AS VARCHAR(20)) AS line1, body2 || CAST((1 * (length(body2) - length(replace(body2, '1', ''))) + 2 * (length(body2) - length(replace(body2, '2', ''))) + 3 * (length(body2) - length(replace(body2, '3', ''))) + 4 * (length(body2) - length(replace(body2, '4', ''))) + 5 * (length(body2) - length(replace(body2, '5', ''))) + 6 * (length(body2) - length(replace(body2, '6', ''))) + 7 * (length(body2) - length(replace(body2, '7', ''))) + 8 * (length(body2) - length(replace(body2, '8', ''))) + 9 * (length(body2) - length(replace(body2, '9', ''))) + length(body2) - length(replace(body2, '-', ''))) % 10 AS VARCHAR(20)) AS line2
        FROM {tle_bodies}""",
    "tle_lines": """
        SELECT k AS file, set_id * 10 AS place, '# set ' || CAST(set_id AS VARCHAR(20)) AS line FROM {tle_sets} WHERE set_id % 5 = 0
        UNION ALL SELECT k, set_id * 10 + 1, name FROM {tle_sets} WHERE set_id % 3 <> 0
        UNION ALL SELECT k, set_id * 10 + 2, line1 FROM {tle_sets} UNION ALL SELECT k, set_id * 10 + 3, line2 FROM {tle_sets} WHERE set_id % 17 <> 4
        UNION ALL SELECT k, set_id * 10 + 4, '' FROM {tle_sets} WHERE set_id % 4 = 0""",
}


def inputs(name: str) -> list[str]:
    """The tables and proxies that a proxy reads."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", PROXIES[name])))


class Tables:
    """Attribute access to the tables of ``sf_dir`` and to the proxies over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in PROXIES:
            return self.spark.sql(PROXIES[name], **{t: getattr(self, t) for t in inputs(name)})
        raise AttributeError(name)

    @cached_property
    def partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))


def with_proxies(sql: str) -> str:
    """``sql`` for an engine that knows the raw tables only: the proxies that it names become common table expressions."""
    needed: list[str] = []

    def need(name: str) -> None:
        for x in inputs(name):
            if x in PROXIES:
                need(x)
        if name not in needed:
            needed.append(name)

    for name in PROXIES:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, re.I):
            need(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({PROXIES[n].format(**{t: t for t in inputs(n)})})" for n in needed)
    return f"WITH {ctes}\nSELECT * FROM ({sql})"
