"""Queries over monitoring rules (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zenithal.operators import monitoring
from zenithal.plans.registry import query
from zenithal.plans.tables import EVENTS_AS_OF
from zenithal.streaming import alerts, events
from zenithal.streaming.inorder import ROCKS


@query("o1_increase", "WITH w AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY event_time RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS increase FROM orbital_events) SELECT event_id, event_type, increase FROM w WHERE increase > 20")
def o1(t):
    return monitoring.increase(t.orbital_events, "event_type", "event_time", 6).where("increase > 20").select("event_id", "event_type", "increase")


@query("o2_staleness", f"SELECT event_type, CAST(floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(max(event_time))) / 1e6) AS BIGINT) AS seconds, floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(max(event_time))) / 1e6) > CASE event_type WHEN 'error' THEN 28800 WHEN 'click' THEN 1800 ELSE 600 END AS stale FROM orbital_events GROUP BY event_type")
def o2(t):
    return monitoring.staleness(t.orbital_events, "event_type", "event_time", F.expr(f"TIMESTAMP_NTZ'{EVENTS_AS_OF}'"), {"error": 28800, "click": 1800}, 600)


@query("o3_error_ratio", "SELECT date_trunc('hour', event_time) AS hour, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio, count(*) FILTER (event_type = 'error') / count(*) > 0.05 AS alert FROM orbital_events GROUP BY 1")
def o3(t):
    ratio = F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    return t.orbital_events.groupBy(F.date_trunc("hour", F.col("event_time")).cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(ratio, 6).alias("ratio"), (ratio > 0.05).alias("alert"))


@query("o4_bucket_quantile", """
WITH b AS (SELECT event_type, le, (SELECT count(*) FROM orbital_events x WHERE x.event_type = e.event_type AND x.value <= le) AS n FROM (SELECT DISTINCT event_type FROM orbital_events) e, (VALUES (5e0), (25e0), (50e0), (100e0), (250e0), (CAST('Infinity' AS DOUBLE))) v(le)),
r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before, 0.95e0 * max(n) OVER (PARTITION BY event_type) AS rank FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)), h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS k FROM r WHERE n >= rank)
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 6) AS p95 FROM h WHERE k = 1""")
def o4(t):
    bounds = [5.0, 25.0, 50.0, 100.0, 250.0, float("inf")]
    wide = t.orbital_events.groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    buckets = wide.select("event_type", F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])))
    return monitoring.bucket_quantile(buckets, "event_type", 0.95).select("event_type", F.round("quantile", 6).alias("p95"))


@query("o5_availability", "SELECT norad_id, arg_max(value, (event_time, event_id)) AS last_value, arg_max(value, (event_time, event_id)) < 5 AS down FROM orbital_events GROUP BY 1")
def o5(t):
    last = t.orbital_events.groupBy("norad_id").agg(F.max_by("value", F.struct("event_time", "event_id")).alias("last_value"))
    return last.select("norad_id", "last_value", (F.col("last_value") < 5).alias("down"))


@query("o6_burn_in", """
WITH e AS (SELECT *, event_id % 23 <> 0 AS ok FROM orbital_events), c AS (SELECT event_type, count(*) AS polls, count(*) FILTER (NOT ok) AS outages, min(event_time) FILTER (NOT ok) AS first_error, max(event_time) FILTER (NOT ok) AS last_error FROM e GROUP BY 1),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_time DESC) AS k FROM e WHERE ok), p AS (SELECT event_type, list_sort(list(value)) AS s FROM r WHERE k <= 100 GROUP BY 1)
SELECT event_type, polls, outages, first_error, last_error, s[least(CAST(floor(len(s) * 0.95e0) AS BIGINT), len(s) - 1) + 1] AS p95, round(100e0 * (polls - outages) / polls, 2) AS uptime_pct FROM c JOIN p USING (event_type)""")
def o6(t):
    return monitoring.burn_in(t.orbital_events, "event_type", "event_time", "value", F.col("event_id") % 23 != 0)


#: The rule of o7: values over 40 held for three hours; rows may be an hour late.
_HOLD, _LATE = 3 * 3_600_000, 3_600_000


@query("o7_alert_states", f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS tm, coalesce(value > 40, false) AS bad FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), w AS (SELECT max(tm) - {_LATE} AS mark FROM e),
s AS (SELECT e.*, bad AND NOT coalesce(lag(bad) OVER o, false) AS turned, NOT bad AND coalesce(lag(bad) OVER o, false) AS ended FROM e, w WHERE tm <= mark WINDOW o AS (PARTITION BY user_id ORDER BY tm, event_id)),
r AS (SELECT user_id, tm AS since, kind, lead(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS until FROM (SELECT user_id, event_id, tm, turned AS kind FROM s WHERE turned OR ended)), i AS (SELECT r.*, since + {_HOLD} < coalesce(until, mark + 1) AS fires, mark FROM r, w WHERE kind),
t AS (SELECT user_id, 'pending' AS state, since AS at_ms, since AS since_ms FROM i UNION ALL SELECT user_id, 'firing', since + {_HOLD}, since FROM i WHERE fires UNION ALL SELECT user_id, CASE WHEN fires THEN 'resolved' ELSE 'dropped' END, until, since FROM i WHERE until IS NOT NULL)
SELECT * FROM t""")
def o7(t):
    """A stream of samples; the alerts of each user change their state as the watermark passes."""
    typed = lambda df: df.selectExpr("user_id", "event_id", "value", "cast(ts AS timestamp) AS time")
    states = lambda df: alerts.alert_states(df, "user_id", "time", "event_id", F.col("value") > 40, _HOLD, "1 hour")
    return events.run_once(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema, states, prepare=typed, conf=ROCKS)
