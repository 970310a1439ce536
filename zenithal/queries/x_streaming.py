"""Queries over streams (X): each is run on what the table holds, through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from zenithal.plans.registry import query
from zenithal.plans.tables import PROXIES
from zenithal.streaming import cache, events, leases
from zenithal.streaming.inorder import ROCKS

RISK = "CASE WHEN pc >= 1e-3 THEN 'red' WHEN pc >= 1e-4 THEN 'yellow' WHEN pc >= 1e-5 THEN 'green' ELSE 'white' END"
_AS_OF = "TIMESTAMP_NTZ'1999-06-01 00:00:00'"


def _stream(t, table: str, fn, mode: str = "append", prepare=None, conf=None):
    path = f"{t.sf_dir}/{table}.parquet"
    raw = getattr(t, table)
    # A folder is read as it is; a single file is named by a pattern, as streams read folders or patterns.
    return events.run_once(t.spark, path + "*", raw.schema, fn, mode, prepare, conf)


def _orbital(df):
    return df.selectExpr("event_id", "user_id AS norad_id", "event_type", "cast(ts AS timestamp) AS event_time", "value")


@query("x1_alert_publish", f"SELECT conjunction_id, {RISK} AS risk, round(greatest(0, (epoch_us(tca) - epoch_us(TIMESTAMP '1999-06-01')) / 3600e6), 2) AS hours_remaining FROM conjunctions WHERE pc >= 1e-4")
def x1(t):
    prepare = lambda df: t.spark.sql(PROXIES["conjunctions"], orders=df)
    return _stream(t, "orders", lambda c: events.alerts(c, F.expr(_AS_OF)), prepare=prepare).select("conjunction_id", "risk", "hours_remaining")


@query("x2_alert_consume", f"SELECT conjunction_id, {RISK} AS risk, CAST(NULL AS VARCHAR) AS raw FROM conjunctions WHERE pc >= 1e-4 AND conjunction_id % 50 <> 0 UNION ALL SELECT NULL, NULL, 'broken ' || CAST(conjunction_id AS VARCHAR) FROM conjunctions WHERE pc >= 1e-4 AND conjunction_id % 50 = 0")
def x2(t):
    def consume(c):
        sent = events.alerts(c, F.expr(_AS_OF))
        damaged = F.when(F.col("conjunction_id") % 50 == 0, F.concat(F.lit("broken "), "conjunction_id")).otherwise(F.col("payload"))
        return events.parse_alerts(sent.select(damaged.alias("payload")))

    prepare = lambda df: t.spark.sql(PROXIES["conjunctions"], orders=df)
    return _stream(t, "orders", consume, prepare=prepare).select("conjunction_id", "risk", "raw")


@query("x3_live_positions", "SELECT r.r_regionkey AS tick, s.norad_id, s.x, s.y, s.z FROM region r CROSS JOIN states s")
def x3(t):
    """A tick per region row; the whole snapshot at each."""
    ticks = lambda df: df.select(F.col("r_regionkey").alias("timestamp"))
    out = _stream(t, "region", lambda df: events.live_positions(ticks(df), t.states))
    return out.select(F.col("timestamp").alias("tick"), "norad_id", "x", "y", "z")


@query("x4_interval_job", "SELECT event_type, count(*) AS n, max(event_time) AS last FROM orbital_events GROUP BY 1")
def x4(t):
    """What a job that runs at fixed intervals keeps: totals over all that has come so far."""
    out = _stream(t, "events", lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")), mode="complete")
    return out.select("event_type", "n", "last")


_LATE, _LEASE, _EVERY = 3_600_000, 45 * 60_000, 2 * 3_600_000


@query("x4_job_leases", f"""
WITH RECURSIVE e AS (SELECT user_id AS job, event_id AS id, event_type AS owner, epoch_us(ts) // 1000 AS tm, epoch_us(ts + to_microseconds(CAST(floor(value * 60000) AS BIGINT) * 1000)) // 1000 AS ends FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
w AS (SELECT max(greatest(tm, ends)) - {_LATE} AS mark FROM e), s AS (SELECT e.*, mark, row_number() OVER (PARTITION BY job ORDER BY tm, id) AS k FROM e, w WHERE tm <= mark),
r AS (SELECT job, id, owner, tm, ends, mark, k, 'run' AS outcome, CAST(1 AS BIGINT) AS fence, CAST(1 AS BIGINT) AS folded, least(ends, tm + {_LEASE}) AS until, tm // {_EVERY} AS last FROM s WHERE k = 1 UNION ALL
SELECT s.job, s.id, s.owner, s.tm, s.ends, s.mark, s.k, CASE WHEN s.tm < r.until THEN 'busy' WHEN s.tm // {_EVERY} <= r.last THEN 'done' ELSE 'run' END, CASE WHEN s.tm >= r.until AND s.tm // {_EVERY} > r.last THEN r.fence + 1 ELSE r.fence END,
  CASE WHEN s.tm >= r.until AND s.tm // {_EVERY} > r.last THEN s.tm // {_EVERY} - r.last ELSE 0 END, CASE WHEN s.tm >= r.until AND s.tm // {_EVERY} > r.last THEN least(s.ends, s.tm + {_LEASE}) ELSE r.until END, CASE WHEN s.tm >= r.until THEN greatest(r.last, s.tm // {_EVERY}) ELSE r.last END
FROM r JOIN s ON s.job = r.job AND s.k = r.k + 1)
SELECT job, id, owner, outcome, tm AS at_ms, fence, folded FROM r UNION ALL SELECT job, id, owner, 'released', ends, fence, 0 FROM r WHERE outcome = 'run' AND ends < tm + {_LEASE} AND ends <= mark""")
def x4_leases(t):
    """Events are attempts to run a job (each user's own, due every two hours) for as many minutes as their value."""
    typed = lambda df: df.where("value is not null").selectExpr("user_id AS job", "event_id", "event_type", "cast(ts AS timestamp) AS time", "cast(ts AS timestamp) + make_interval(0, 0, 0, 0, 0, 0, floor(value * 60000) / 1000) AS ends")
    run = lambda df: leases.leases(df, "job", "time", "event_id", "event_type", "ends", _LEASE, _EVERY, "1 hour")
    return _stream(t, "events", run, prepare=typed, conf=ROCKS)


@query("x5_sliding_rate", "WITH w AS (SELECT event_id, norad_id, count(*) OVER (PARTITION BY norad_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM orbital_events) SELECT event_id, norad_id, n, n > 2 AS limited FROM w WHERE n > 1")
def x5(t):
    from zenithal.operators.monitoring import increase

    rows = increase(t.orbital_events, "norad_id", "event_time", 1).where("increase > 1")
    return rows.select("event_id", "norad_id", F.col("increase").alias("n"), (F.col("increase") > 2).alias("limited"))


_TTL = 4 * 3_600_000


@query("x6_snapshot_fallback", f"""
WITH e AS (SELECT event_id, user_id, value, event_type = 'click' AS put, epoch_us(ts) // 1000 AS tm FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), w AS (SELECT max(tm) - {_LATE} AS mark FROM e),
p AS (SELECT e.*, last_value(CASE WHEN put THEN tm END IGNORE NULLS) OVER o AS since, arg_max(value, (tm, event_id)) FILTER (put) OVER o AS cached FROM e, w WHERE tm <= mark WINDOW o AS (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT user_id AS norad_id, event_id, CASE WHEN tm - since < {_TTL} THEN cached END AS cached, CASE WHEN tm - since < {_TTL} THEN tm - since END AS age_ms FROM p WHERE NOT put)
SELECT a.norad_id, event_id, CASE WHEN cached IS NOT NULL THEN 'cache' WHEN c.tle_line1 IS NOT NULL AND c.tle_age_days * 86400000 <= 604800000 THEN 'table' ELSE 'default' END AS source,
  CASE WHEN cached IS NOT NULL THEN cached WHEN c.tle_line1 IS NOT NULL AND c.tle_age_days * 86400000 <= 604800000 THEN c.perigee_km ELSE 0e0 END AS altitude, age_ms FROM a LEFT JOIN catalog c ON c.norad_id = a.norad_id""")
def x6(t):
    """Clicks put a state into the cache, all other events ask for it. A cached state may be four hours old, a row of the catalogue
    seven days; else the default is the answer."""
    typed = lambda df: df.selectExpr("user_id AS norad_id", "event_id", "event_type", "value", "cast(ts AS timestamp) AS time")
    ask = lambda df: cache.cached(df, "norad_id", "time", "event_id", F.col("event_type") == "click", F.col("value"), _TTL, "1 hour")
    answers = _stream(t, "events", ask, prepare=typed, conf=ROCKS)
    table = t.catalog.select("norad_id", F.when(F.col("tle_line1").isNotNull(), F.col("perigee_km")).alias("stored"), (F.col("tle_age_days") * 86_400_000).alias("stored_age"))
    source, altitude = cache.first_source([("cache", F.col("cached"), F.col("age_ms")), ("table", F.col("stored"), F.col("stored_age"))], {"cache": _TTL, "table": 7 * 86_400_000}, F.lit(0.0))
    return answers.join(table, "norad_id", "left").select("norad_id", F.col("id").alias("event_id"), source.alias("source"), altitude.alias("altitude"), "age_ms")


@query("x8_idempotent_log", "SELECT DISTINCT event_id, event_type FROM orbital_events")
def x8(t):
    twice = lambda df: _orbital(df).union(_orbital(df))
    return _stream(t, "events", lambda e: events.once_per_key(e, ["event_id"], "event_time"), prepare=twice).select("event_id", "event_type")


@query("x_ext_tumbling_window", "SELECT date_trunc('hour', event_time) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) AS total FROM orbital_events GROUP BY 1, 2")
def x_window(t):
    """An extension: hourly windows with a watermark, all windows that have been seen."""
    out = _stream(t, "events", lambda e: events.windowed(e, "event_time", "1 hour", None, "1 day", "event_type", "value"), mode="complete", prepare=_orbital)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("x_ext_rising_streaks", "WITH o AS (SELECT norad_id, event_id, value, lag(value) OVER w AS previous FROM orbital_events WINDOW w AS (PARTITION BY norad_id ORDER BY event_id)), g AS (SELECT *, sum(CASE WHEN previous IS NULL OR value <= previous THEN 1 ELSE 0 END) OVER (PARTITION BY norad_id ORDER BY event_id) AS run FROM o) SELECT norad_id, event_id, value, previous, CAST(row_number() OVER (PARTITION BY norad_id, run ORDER BY event_id) AS INTEGER) AS streak FROM g")
def x_streak(t):
    """An extension: state per object across micro-batches."""
    return _stream(t, "events", events.rising_streaks, prepare=_orbital)
