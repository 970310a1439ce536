"""Queries over scalar functions of the domain (B)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from zenithal.functions import frames, ids, manoeuvre, orbit, probability, relative, tle, weather
from zenithal.plans.registry import query
from zenithal.plans.tables import AS_OF, EVENTS_AS_OF

R, MU = "6378.137e0", "398600.4418e0"
_r = lambda c, n=6: F.round(c, n)


def _rounded(df, columns: dict, keys: list[str], digits: int = 6):
    return df.select(*keys, *[F.round(c, digits).alias(k) for k, c in columns.items()])


@query("b1_regime_from_elements", f"""
WITH o AS (SELECT norad_id, semi_major_axis_km AS a, eccentricity AS e, inclination_deg AS i FROM catalog),
x AS (SELECT *, a * (1 - e) - {R} AS p, a * (1 + e) - {R} AS q, a - {R} AS m, 2 * pi() * sqrt(pow(a, 3) / {MU}) / 60 AS t,
  degrees(-1.5 * sqrt({MU} / pow(a, 3)) * 1.08262668e-3 * pow({R} / a, 2) * cos(radians(i)) / pow(1 - e * e, 2)) * 86400 AS drift FROM o),
y AS (SELECT *, abs(drift - 0.98561) < 0.05 AND i > 80 AND i < 115 AS sun FROM x),
z AS (SELECT *, CASE WHEN q > 300000 THEN 'DSO' WHEN q > 100000 THEN 'TLI' WHEN e > 0.25 THEN 'HEO' WHEN p < 2000 AND q > 30000 AND e > 0.5 THEN 'GTO'
  WHEN abs(m - 35786) < 200 AND e < 0.01 AND i < 2 THEN 'GEO' WHEN abs(m - 35786) < 500 AND e < 0.05 THEN 'GEO2' WHEN m > 2000 THEN 'MEO' WHEN sun THEN 'SSO' WHEN m < 450 THEN 'VLEO' ELSE 'LEO' END AS k FROM y)
SELECT norad_id, left(k, CASE WHEN k = 'GEO2' THEN 3 ELSE 9 END) AS regime,
  CAST(CASE k WHEN 'DSO' THEN 0.99 WHEN 'HEO' THEN 0.97 WHEN 'GTO' THEN 0.93 WHEN 'GEO' THEN 0.98 WHEN 'GEO2' THEN 0.85 WHEN 'SSO' THEN 0.97 WHEN 'VLEO' THEN 0.96 ELSE 0.95 END AS DOUBLE) AS confidence,
  CASE k WHEN 'DSO' THEN 'Deep space' WHEN 'HEO' THEN CASE WHEN i > 62 AND i < 65 AND t > 700 AND t < 760 THEN 'Molniya' WHEN i > 62 AND i < 65 AND t > 1400 AND t < 1460 THEN 'Tundra' END
    WHEN 'GEO' THEN 'Geostationary' WHEN 'GEO2' THEN 'Near-GEO' WHEN 'MEO' THEN CASE WHEN i > 55 AND i < 57 AND t > 660 AND t < 690 THEN 'GPS-like' END WHEN 'SSO' THEN 'Sun-sync LEO' END AS sub_type, k = 'SSO' AS sso, k = 'GEO' AS geo_belt
FROM z""")
def b1(t):
    return t.catalog.select("norad_id", orbit.regime_from_elements(F.col("semi_major_axis_km"), F.col("eccentricity"), F.col("inclination_deg")).alias("r")).select("norad_id", "r.*")


_ALT = "CASE WHEN {m} < 0 THEN 'UNKNOWN' WHEN {m} < 450 THEN 'VLEO' WHEN {m} < 2000 THEN CASE WHEN inclination_deg BETWEEN 96 AND 100 THEN 'SSO' ELSE 'LEO' END WHEN {m} < 35000 THEN 'MEO' WHEN {m} <= 36500 THEN 'GEO' ELSE 'HEO' END"


@query("b2_regime_from_altitude", f"SELECT norad_id, {_ALT.format(m='perigee_km')} AS regime FROM catalog")
def b2(t):
    return t.catalog.select("norad_id", orbit.regime_from_altitude(F.col("perigee_km"), F.col("inclination_deg")).alias("regime"))


@query("b3_regime_stored_or_computed", f"SELECT norad_id, CASE WHEN stored_regime IS NOT NULL THEN upper(stored_regime) ELSE {_ALT.format(m='(perigee_km + apogee_km) / 2')} END AS regime FROM catalog")
def b3(t):
    return t.catalog.select("norad_id", orbit.regime_stored_or_computed(*map(F.col, ("stored_regime", "perigee_km", "apogee_km", "inclination_deg"))).alias("regime"))


@query("b4_object_type", "SELECT norad_id, CASE lower(object_type) WHEN 'payload' THEN 'PAYLOAD' WHEN 'satellite' THEN 'PAYLOAD' WHEN 'debris' THEN 'DEBRIS' WHEN 'r/b' THEN 'ROCKET_BODY' ELSE 'UNKNOWN' END AS object_type FROM catalog")
def b4(t):
    return t.catalog.select("norad_id", orbit.object_type(F.col("object_type")).alias("object_type"))


@query("b5_risk_band", "SELECT conjunction_id, CASE WHEN pc >= 1e-3 THEN 'red' WHEN pc >= 1e-4 THEN 'yellow' WHEN pc >= 1e-5 THEN 'green' ELSE 'white' END AS risk FROM conjunctions")
def b5(t):
    return t.conjunctions.select("conjunction_id", orbit.risk_band(F.col("pc")).alias("risk"))


@query("b6_derived_orbit", f"""
WITH m AS (SELECT norad_id, eccentricity AS e, 1 + norad_id % 16 + 0.25e0 AS n FROM catalog), a AS (SELECT *, pow({MU} / pow(n * 2 * pi() / 86400, 2), 1e0 / 3) AS a FROM m)
SELECT norad_id, round(a, 6) AS axis_km, round(a * (1 - e) - {R}, 6) AS perigee_km, round(a * (1 + e) - {R}, 6) AS apogee_km, round(1440 / n, 6) AS period_min FROM a""")
def b6(t):
    n = 1 + F.col("norad_id") % 16 + 0.25
    a, e = orbit.semi_major_axis(n), F.col("eccentricity")
    return _rounded(t.catalog, {"axis_km": a, "perigee_km": a * (1 - e) - orbit.EARTH_RADIUS_KM, "apogee_km": a * (1 + e) - orbit.EARTH_RADIUS_KM, "period_min": 1440 / n}, ["norad_id"])


@query("b8_julian_date", """
WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events)
SELECT event_id, us // 86400000000 + 2440587.5e0 AS jd, round((us % 86400000000) / 86400000000e0, 12) AS fraction, make_timestamp(us) AS back, true AS valid FROM e""")
def b8(t):
    day, fr = frames.julian_date(F.col("ts"))
    return t.events.select("event_id", day.alias("jd"), F.round(fr, 12).alias("fraction"), frames.from_julian(day, fr).alias("back"), frames.julian_valid(day, fr).alias("valid"))


_GMST = "fmod((67310.54841e0 + 3164400184.812866e0 * t + 0.093104e0 * t * t - 6.2e-6 * t * t * t) * (2 * pi() / 86400), 2 * pi())"
_T = "((epoch_us(ts) - 946728000000000) / 86400000000e0 / 36525e0)"


@query("b9_gmst", f"SELECT event_id, round({_GMST}, 6) AS gmst FROM (SELECT event_id, {_T} AS t FROM events)")
def b9(t):
    return t.events.select("event_id", _r(frames.gmst(F.col("ts"))).alias("gmst"))




def _p():
    return [F.col(c) for c in ("x", "y", "z")]


def _v():
    return [F.col(c) for c in ("vx", "vy", "vz")]


def _angle():
    return F.col("norad_id") % 628 / 100.0


@query("b10_eci_to_ecef", "WITH s AS (SELECT *, (norad_id % 628) / 100e0 AS a FROM states) SELECT norad_id, round(cos(a) * x + sin(a) * y, 6) AS x, round(cos(a) * y - sin(a) * x, 6) AS y, round(z, 6) AS z FROM s")
def b10(t):
    return _rounded(t.states, dict(zip("xyz", frames.rotate(_p(), _angle()), strict=True)), ["norad_id"])


_E2, _B = repr(frames.E2), repr(frames.POLAR_RADIUS_KM)
_N = f"({R} / sqrt(1 - {_E2} * sin({{0}}) * sin({{0}})))"


@query("b11_ecef_to_geodetic", f"""
WITH s AS (SELECT norad_id, x, y, z, sqrt(x * x + y * y) AS p, atan2(z * {R}, sqrt(x * x + y * y) * {_B}) AS th FROM states),
l0 AS (SELECT *, atan2(z + ({R} * {R} - {_B} * {_B}) / {_B} * pow(sin(th), 3), p - {_E2} * {R} * pow(cos(th), 3)) AS a FROM s),
l1 AS (SELECT *, atan2(z + {_E2} * {_N.format('a')} * sin(a), p) AS b FROM l0), l2 AS (SELECT *, atan2(z + {_E2} * {_N.format('b')} * sin(b), p) AS c FROM l1), l3 AS (SELECT *, atan2(z + {_E2} * {_N.format('c')} * sin(c), p) AS d FROM l2)
SELECT norad_id, round(degrees(d), 6) AS lat_deg, round(degrees(atan2(y, x)), 6) AS lon_deg, round(p / cos(d) - {_N.format('d')}, 6) AS alt_km FROM l3""")
def b11(t):
    return _rounded(t.states, frames.geodetic(_p()), ["norad_id"])


@query("b12_eci_to_spherical", f"SELECT norad_id, round(degrees(asin(z / sqrt(x*x + y*y + z*z))), 6) AS lat_deg, round(degrees(atan2(y, x)), 6) AS lon_deg, round(sqrt(x*x + y*y + z*z) - {R}, 6) AS alt_km FROM states")
def b12(t):
    return _rounded(t.states, frames.spherical(_p()), ["norad_id"])


@query("b13_teme_to_eci", """
WITH s AS (SELECT *, (norad_id % 628) / 100e0 AS a FROM states), q AS (SELECT *, cos(a) * x - sin(a) * y AS qx, sin(a) * x + cos(a) * y AS qy, cos(a) * vx - sin(a) * vy AS wx, sin(a) * vx + cos(a) * vy AS wy FROM s)
SELECT norad_id, round(qx, 6) AS x, round(qy, 6) AS y, round(z, 6) AS z, round(wx + 7.2921150e-5 * qy, 6) AS vx, round(wy - 7.2921150e-5 * qx, 6) AS vy, round(vz, 6) AS vz FROM q""")
def b13(t):
    p, v = frames.teme_to_eci(_p(), _v(), _angle())
    return _rounded(t.states, dict(zip(relative.NAMES, p + v, strict=True)), ["norad_id"])


@query("b14_eci_to_lvlh", """
WITH p AS (SELECT norad_id, x, y, z, vx, vy, vz, x + 1.5e0 AS dx, y - 0.5e0 AS dy, z + 0.25e0 AS dz, vx + 0.001e0 AS ux, vy - 0.002e0 AS uy, vz + 0.003e0 AS uz FROM states),
h AS (SELECT *, y * vz - z * vy AS hx, z * vx - x * vz AS hy, x * vy - y * vx AS hz FROM p),
n AS (SELECT *, sqrt(x*x + y*y + z*z) AS r, sqrt(hx*hx + hy*hy + hz*hz) AS h FROM h),
u AS (SELECT *, x / r AS rx, y / r AS ry, z / r AS rz, hx / h AS ox, hy / h AS oy, hz / h AS oz, h / (r * r) AS w FROM n),
t AS (SELECT *, oy * rz - oz * ry AS tx, oz * rx - ox * rz AS ty, ox * ry - oy * rx AS tz, dx - x AS ex, dy - y AS ey, dz - z AS ez, ux - vx AS fx, uy - vy AS fy, uz - vz AS fz FROM u),
q AS (SELECT *, rx*ex + ry*ey + rz*ez AS px, tx*ex + ty*ey + tz*ez AS py, ox*ex + oy*ey + oz*ez AS pz, rx*fx + ry*fy + rz*fz AS gx, tx*fx + ty*fy + tz*fz AS gy, ox*fx + oy*fy + oz*fz AS gz FROM t)
SELECT norad_id, round(px, 6) AS x, round(py, 6) AS y, round(pz, 6) AS z, round(gx - (w * oy * pz - w * oz * py), 6) AS vx, round(gy - (w * oz * px - w * ox * pz), 6) AS vy, round(gz - (w * ox * py - w * oy * px), 6) AS vz FROM q""")
def b14(t):
    deputy = [a + b for a, b in zip(_p() + _v(), (1.5, -0.5, 0.25, 0.001, -0.002, 0.003), strict=True)]
    pos, vel = frames.lvlh(_p(), _v(), deputy[:3], deputy[3:])
    return _rounded(t.states, dict(zip(relative.NAMES, pos + vel, strict=True)), ["norad_id"])


def _site(lat: float, lon: float, alt: float) -> tuple[float, ...]:
    a, b = math.radians(lat), math.radians(lon)
    n = orbit.EARTH_RADIUS_KM / math.sqrt(1 - frames.E2 * math.sin(a) ** 2)
    return ((n + alt) * math.cos(a) * math.cos(b), (n + alt) * math.cos(a) * math.sin(b), (n * (1 - frames.E2) + alt) * math.sin(a), math.sin(a), math.cos(a), math.sin(b), math.cos(b))


_SX, _SY, _SZ, _SLA, _CLA, _SLO, _CLO = map(repr, _site(48.1, 11.6, 0.5))


@query("b15_look_angles", f"""
WITH s AS (SELECT *, (norad_id % 628) / 100e0 AS a FROM states), d AS (SELECT norad_id, cos(a) * x + sin(a) * y - {_SX} AS dx, cos(a) * y - sin(a) * x - {_SY} AS dy, z - {_SZ} AS dz FROM s),
r AS (SELECT norad_id, {_SLA} * {_CLO} * dx + {_SLA} * {_SLO} * dy - {_CLA} * dz AS s, -{_SLO} * dx + {_CLO} * dy AS e, {_CLA} * {_CLO} * dx + {_CLA} * {_SLO} * dy + {_SLA} * dz AS u FROM d)
SELECT norad_id, round(CASE WHEN atan2(-s, e) < 0 THEN degrees(atan2(-s, e)) + 360 ELSE degrees(atan2(-s, e)) END, 6) AS azimuth_deg, round(degrees(asin(u / sqrt(s*s + e*e + u*u))), 6) AS elevation_deg, round(sqrt(s*s + e*e + u*u), 6) AS range_km FROM r""")
def b15(t):
    return _rounded(t.states, frames.look_angles(_p(), 48.1, 11.6, 0.5, _angle()), ["norad_id"])


@query("b18_epoch_grid", "SELECT conjunction_id, unnest(generate_series(tca, tca + INTERVAL 6 HOUR, INTERVAL 30 MINUTE)) AS epoch FROM conjunctions WHERE pc >= 1e-2")
def b18(t):
    grid = F.sequence("tca", F.col("tca") + F.expr("INTERVAL 6 HOURS"), F.expr("INTERVAL 30 MINUTES"))
    return t.conjunctions.where("pc >= 1e-2").select("conjunction_id", F.explode(grid).alias("epoch"))


@query("b19_j2_velocity", f"""
WITH s AS (SELECT *, sqrt(x*x + y*y + z*z) AS r FROM states), k AS (SELECT *, 1.5e0 * 1.08262668355e-3 * {R} * {R} / pow(r, 5) * {MU} AS k, 5 * z * z / (r * r) AS c FROM s)
SELECT norad_id, round(CASE WHEN r - {R} < 2000 THEN vx + k * x * (c - 1) ELSE vx END, 8) AS vx, round(CASE WHEN r - {R} < 2000 THEN vy + k * y * (c - 1) ELSE vy END, 8) AS vy, round(CASE WHEN r - {R} < 2000 THEN vz + k * z * (c - 3) ELSE vz END, 8) AS vz FROM k""")
def b19(t):
    return _rounded(t.states, dict(zip(("vx", "vy", "vz"), frames.j2_velocity(_p(), _v()), strict=True)), ["norad_id"], 8)


@query("b20_state_plausible", f"SELECT norad_id, CAST(CASE WHEN sqrt(x*x + y*y + z*z) - {R} BETWEEN 80 AND 400000 AND sqrt(vx*vx + vy*vy + vz*vz) BETWEEN 0.5 AND 12 THEN 0 ELSE 99 END AS INTEGER) AS error_code FROM states")
def b20(t):
    return t.states.select("norad_id", orbit.plausible(_p(), _v()).alias("error_code"))


@query("b21_epoch_age", f"""
WITH a AS (SELECT norad_id, record_id, rev_number, element_set_num, epoch, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(epoch)) / 86400e6 AS age_days FROM tle_records)
SELECT norad_id, record_id, rev_number, element_set_num, epoch, round(age_days, 6) AS age_days, age_days BETWEEN -1 AND 30 AS age_ok, age_days <= 7 AS fresh FROM a""")
def b21(t):
    c = tle.age_check(F.col("epoch"), F.expr(f"TIMESTAMP_NTZ'{AS_OF}'"))
    return t.tle_records.select("norad_id", "record_id", "rev_number", "element_set_num", "epoch", _r(c["age_days"]).alias("age_days"), c["age_ok"].alias("age_ok"), c["fresh"].alias("fresh"))


def _start():
    return {k: F.col(f"{k}0") for k in relative.NAMES}


_CW_SQL = "SELECT norad_id, (norad_id % 21) / 10e0 - 1 AS x0, (norad_id % 31) / 10e0 - 1.5e0 AS y0, (norad_id % 11) / 10e0 - 0.5e0 AS z0, (norad_id % 7) / 10000e0 AS vx0, (norad_id % 5) / 10000e0 AS vy0, (norad_id % 3) / 10000e0 AS vz0, sqrt(398600.4418e0 / pow(6378.137e0 + perigee_km, 3)) AS n FROM {src}"


def _cw(t):
    return t.spark.sql(_CW_SQL.format(src="{catalog}"), catalog=t.catalog)


@query("b22_cw_trajectory", f"""
WITH c AS ({_CW_SQL.format(src='catalog')}), g AS (SELECT *, unnest(generate_series(0, 3600, 600)) AS t FROM c), a AS (SELECT *, n * t AS q, cos(n * t) AS k, sin(n * t) AS s FROM g)
SELECT norad_id, CAST(t AS INTEGER) AS t, round((4 - 3*k)*x0 + s*vx0/n + 2*(1-k)*vy0/n, 6) + 0e0 AS x, round(6*(s-q)*x0 + y0 - 2*(1-k)*vx0/n + (4*s-3*q)*vy0/n, 6) + 0e0 AS y, round(z0*k + vz0*s/n, 6) + 0e0 AS z,
  round(3*n*s*x0 + k*vx0 + 2*s*vy0, 8) + 0e0 AS vx, round(6*n*(k-1)*x0 - 2*s*vx0 + (4*k-3)*vy0, 8) + 0e0 AS vy, round(vz0*k - n*z0*s, 8) + 0e0 AS vz FROM a""")
def b22(t):
    grid = _cw(t).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3600), F.lit(600))))
    s = relative.propagate(_start(), F.col("n"), F.col("t"))
    return grid.select("norad_id", "t", *[F.round(s[k], 6 if len(k) == 1 else 8).alias(k) for k in relative.NAMES])


@query("b23_cw_transition_matrix", f"""
WITH c AS ({_CW_SQL.format(src='catalog')}), a AS (SELECT norad_id, n, n * 900 AS q, cos(n * 900) AS c, sin(n * 900) AS s FROM c)
SELECT norad_id, list_transform([4-3*c, 0, 0, s/n, 2*(1-c)/n, 0, 6*(s-q), 1, 0, -2*(1-c)/n, (4*s-3*q)/n, 0, 0, 0, c, 0, 0, s/n, 3*n*s, 0, 0, c, 2*s, 0, 6*n*(c-1), 0, 0, -2*s, 4*c-3, 0, 0, 0, -n*s, 0, 0, c], lambda v: round(v, 8)) AS phi FROM a""")
def b23(t):
    flat = [x if not isinstance(x, float) else F.lit(x) for row in relative.transition(F.col("n"), F.lit(900.0)) for x in row]
    return _cw(t).select("norad_id", F.array(*[F.round(x, 8) + 0.0 for x in flat]).alias("phi"))


@query("b24_drift_ellipse", f"""
WITH c AS ({_CW_SQL.format(src='catalog')})
SELECT norad_id, round(sqrt(pow(vx0/n, 2) + pow(2*vy0/n, 2)), 6) AS semi_axis_radial_km, round(2 * sqrt(pow(vx0/n, 2) + pow(2*vy0/n - x0, 2) / 4), 6) AS semi_axis_along_track_km, round(sqrt(z0*z0 + pow(vz0/n, 2)), 6) AS semi_axis_cross_track_km,
  round(y0 - 2*vx0/n, 6) AS ellipse_centre_y_km, round(-2 * n * x0 - vy0, 8) + 0e0 AS null_dvy FROM c""")
def b24(t):
    out = relative.drift_ellipse(_start(), F.col("n"))
    return _cw(t).select("norad_id", *[_r(c).alias(k) for k, c in out.items()], _r(relative.drift_nulling(_start(), F.col("n")), 8).alias("null_dvy"))


@query("b25_two_impulse_rendezvous")
def b25(t):
    return _rounded(_cw(t), relative.rendezvous(_start(), F.col("n"), F.lit(300.0), F.lit(2400.0)), ["norad_id"], 8)


_PCV = "SELECT conjunction_id, miss_distance_km / 5 AS m, 0.05e0 + (conjunction_id % 20) / 100e0 AS sx, 0.02e0 + (conjunction_id % 7) / 100e0 AS sy, 0.005e0 + (conjunction_id % 4) / 200e0 AS hbr FROM {src}"


@query("b26_pc_series", f"""
WITH p AS ({_PCV.format(src='conjunctions')}), h AS (SELECT conjunction_id, (sx + sy) / 2 AS s, pow(hbr / ((sx + sy) / 2), 2) / 2 AS h, pow(m / sx, 2) AS u FROM p)
SELECT conjunction_id, round(greatest(0, least(1, h * exp(-0.5 * u) / (s * s) * exp(h))), 10) AS pc FROM h""")
def b26(t):
    p = t.spark.sql(_PCV.format(src="{c}"), c=t.conjunctions)
    return p.select("conjunction_id", F.round(probability.series(F.pow(F.col("m") / F.col("sx"), 2.0), F.col("sx"), F.col("sy"), F.col("hbr")), 10).alias("pc"))


@query("b27_encounter_plane", """
WITH s AS (SELECT norad_id, 0.1e0 + (norad_id % 9) / 10e0 AS rx, (norad_id % 7) / 10e0 AS ry, (norad_id % 5) / 10e0 AS rz, vx, vy, vz, 0.01e0 + (norad_id % 3) / 100e0 AS c1, 0.04e0 + (norad_id % 4) / 100e0 AS c2, 0.02e0 AS c3 FROM states),
u AS (SELECT *, vx / sqrt(vx*vx + vy*vy + vz*vz) AS ux, vy / sqrt(vx*vx + vy*vy + vz*vz) AS uy, vz / sqrt(vx*vx + vy*vy + vz*vz) AS uz FROM s),
e AS (SELECT *, uy / sqrt(ux*ux + uy*uy) AS ax, -ux / sqrt(ux*ux + uy*uy) AS ay FROM u), f AS (SELECT *, -uz * ay AS b1, uz * ax AS b2, ux * ay - uy * ax AS b3 FROM e),
c AS (SELECT *, ax*ax*c1 + ay*ay*c2 AS aa, ax*b1*c1 + ay*b2*c2 AS ab, b1*b1*c1 + b2*b2*c2 + b3*b3*c3 AS bb, ax*rx + ay*ry AS ra, b1*rx + b2*ry + b3*rz AS rb FROM f)
SELECT norad_id, round(sqrt((aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab*ab)), 6) AS sigma_x, round(sqrt((aa + bb) / 2 - sqrt(pow((aa - bb) / 2, 2) + ab*ab)), 6) AS sigma_y,
  round((bb*ra*ra - 2*ab*ra*rb + aa*rb*rb) / (aa*bb - ab*ab), 6) AS u_sq, round(sqrt(rx*rx + ry*ry + rz*rz), 6) AS miss_km, round(sqrt(vx*vx + vy*vy + vz*vz), 6) AS speed_kms FROM c""")
def b27(t):
    i = F.col("norad_id")
    out = probability.encounter([0.1 + i % 9 / 10.0, i % 7 / 10.0, i % 5 / 10.0], _v(), [0.01 + i % 3 / 100.0, 0.04 + i % 4 / 100.0, F.lit(0.02)])
    return _rounded(t.states, out, ["norad_id"])


@query("b28_pc_quadrature")
def b28(t):
    p = t.spark.sql(_PCV.format(src="{c}"), c=t.conjunctions)
    return p.select("conjunction_id", F.round(probability.quadrature(F.col("m"), F.lit(0.0), F.col("sx"), F.col("sy"), F.col("hbr")), 10).alias("pc"))


_RHO = "CASE WHEN h <= 0 THEN 1.225e0 " + " ".join(f"WHEN h >= {a} AND h < {b} THEN {rho:e} * exp(-(h - {(a + b) / 2}e0) / {scale}e0) * greatest(0.5, 1 + 0.012e0 * (f - 150))" for a, b, scale, rho in orbit.ATMOSPHERE) + " ELSE 3.5e-15 END"


@query("b29_atmospheric_density", f"SELECT norad_id, round(ln({_RHO}), 6) AS log_density FROM (SELECT norad_id, perigee_km AS h, 65e0 + norad_id % 200 AS f FROM catalog)")
def b29(t):
    return t.catalog.select("norad_id", _r(F.log(orbit.density(F.col("perigee_km"), 65.0 + F.col("norad_id") % 200))).alias("log_density"))


@query("b30_decay_rate", f"""
WITH c AS (SELECT norad_id, perigee_km AS h, 65e0 + norad_id % 200 AS f, {R} + perigee_km AS a, eccentricity AS e, CASE WHEN norad_id % 3 = 0 THEN 0 ELSE (norad_id % 17) / 1e5 END AS b FROM catalog),
d AS (SELECT *, {_RHO} AS rho, sqrt({MU} / pow(a, 3)) * a * 1000 AS v, CASE WHEN abs(b) > 1e-10 THEN 2 * b * 6378137e0 / 2.461e-5 ELSE 2.2e-3 END AS k FROM c)
SELECT norad_id, round(ln(rho * k * v * v * (1 + 1.5e0 * e * e) * 86.4e0), 6) AS log_rate FROM d""")
def b30(t):
    i = F.col("norad_id")
    b = F.when(i % 3 == 0, 0.0).otherwise(i % 17 / 1e5)
    return t.catalog.select("norad_id", _r(F.log(-orbit.decay_km_day(F.lit(orbit.EARTH_RADIUS_KM) + F.col("perigee_km"), F.col("eccentricity"), b, 65.0 + i % 200))).alias("log_rate"))


@query("b32_weather_scalars", """
SELECT event_id, CASE WHEN floor(kp) >= 5 THEN 'G' || CAST(least(9, CAST(floor(kp) AS INTEGER)) - 4 AS VARCHAR) ELSE 'NONE' END AS storm, CASE WHEN kp >= 8 THEN 'SEVERE' WHEN kp >= 6 THEN 'STRONG' WHEN kp >= 5 THEN 'MODERATE' WHEN kp >= 4 THEN 'MINOR' ELSE 'NONE' END AS severity,
  CAST([0, 2, 4, 7, 15, 27, 48, 80, 140, 240][CAST(floor(greatest(0, least(9, kp))) AS INTEGER) + 1] AS DOUBLE) AS ap, round(greatest(0.3, least(5.0, 1 + 0.012e0 * (f107 - 150))), 3) AS drag,
  round(least(10, kp / 9 * 6 + least(4, greatest(0, (f107 - 100) / 100) * 4)), 2) AS impact, CASE WHEN kp >= 8 THEN 'G4' WHEN kp >= 6 THEN 'G3' WHEN kp >= 5 THEN 'G2' WHEN kp >= 4 THEN 'G1' ELSE 'none' END AS agent_storm FROM kp""")
def b32(t):
    kp, f = F.col("kp"), F.col("f107")
    return t.kp.select("event_id", weather.storm_level(kp).alias("storm"), weather.severity(kp).alias("severity"), weather.kp_to_ap(kp).alias("ap"), weather.drag_multiplier(f).alias("drag"), weather.impact_score(kp, f).alias("impact"), weather.agent_storm_level(kp).alias("agent_storm"))


_SEV = "CASE " + " ".join(f"WHEN regexp_matches(m, '{w}|G{i}|S{i}|R{i}') THEN '{w}'" for i, w in ((5, "EXTREME"), (4, "SEVERE"), (3, "STRONG"), (2, "MODERATE"), (1, "MINOR"))) + " ELSE 'INFO' END"


@query("b32_alert_severity", f"SELECT event_id, {_SEV} AS severity FROM (SELECT event_id, upper(event_type || CASE event_id % 7 WHEN 0 THEN ' g5 storm' WHEN 1 THEN ' Severe' WHEN 2 THEN ' R3' WHEN 3 THEN ' moderate' WHEN 4 THEN ' s1' ELSE ' quiet' END) AS m FROM events)")
def b32_alerts(t):
    i = F.col("event_id") % 7
    tail = F.when(i == 0, " g5 storm").when(i == 1, " Severe").when(i == 2, " R3").when(i == 3, " moderate").when(i == 4, " s1").otherwise(" quiet")
    return t.events.select("event_id", weather.alert_severity(F.concat("event_type", tail)).alias("severity"))


@query("b33_weather_assembly", """
SELECT event_id, CAST(greatest(-30, least(200, trunc((f107 - 150) * 1.2e0 + (kp - 3) * 10))) AS INTEGER) AS density_effect_pct, round(greatest(0.5, 1 + 0.012e0 * (f107 - 150)), 6) AS drag_multiplier, kp >= 5 AS ssa_alert,
  CASE WHEN kp >= 7 THEN 'Severe drag augmentation — emergency TLE refresh recommended' WHEN kp >= 5 THEN 'Elevated drag — monitor LEO objects closely' WHEN kp >= 4 THEN 'Moderate drag increase' ELSE 'Nominal conditions' END AS impact,
  round(((1 + 0.012e0 * (f107 - 70)) * (1 + 0.05e0 * greatest(0, kp - 3)) - 1) * 100, 6) AS agent_density_pct,
  CASE WHEN kp >= 8 THEN 'Suspend all operations; extreme geomagnetic storm' WHEN kp >= 6 THEN 'Delay maneuvers; significant drag uncertainty' WHEN kp >= 5 THEN 'Monitor closely; mild storm conditions' WHEN kp >= 4 THEN 'No restrictions; minor activity' ELSE 'Nominal operations; quiet conditions' END AS action FROM kp""")
def b33(t):
    kp, f = F.col("kp"), F.col("f107")
    return t.kp.select(
        "event_id", weather.density_effect_pct(kp, f).alias("density_effect_pct"), _r(weather.twin_drag_multiplier(f)).alias("drag_multiplier"), (kp >= 5).alias("ssa_alert"), weather.twin_impact(kp).alias("impact"),
        _r(weather.agent_density_change_pct(f, kp)).alias("agent_density_pct"), weather.agent_action(kp).alias("action"),
    )


@query("b34_weather_forecast", """
WITH g AS (SELECT event_id, kp + 0.013e0 AS kp, unnest(generate_series(0, 24, 3)) AS h FROM kp), p AS (SELECT *, greatest(1, kp - h * 0.05e0) AS p FROM g)
SELECT event_id, CAST(h AS INTEGER) AS hour, round(p, 1) AS kp_projected, CASE WHEN floor(p) >= 5 THEN 'G' || CAST(least(9, CAST(floor(p) AS INTEGER)) - 4 AS VARCHAR) ELSE 'NONE' END AS storm_level,
  round(least(0.95, greatest(0, (kp - 3) / 6)), 6) AS g1_or_above, round(least(0.95, greatest(0, (kp - 6) / 3)), 6) AS g3_or_above, round(least(0.9, greatest(0, kp - 8)), 6) AS g5 FROM p""")
def b34(t):
    out = t.kp.select("event_id", F.explode(weather.forecast(F.col("kp") + 0.013, 24)).alias("f"), *[_r(c).alias(k) for k, c in weather.storm_probabilities(F.col("kp") + 0.013).items()])
    return out.select("event_id", "f.*", "g1_or_above", "g3_or_above", "g5")


_DIR = "CASE norad_id % 4 WHEN 0 THEN 'Prograde' WHEN 1 THEN 'retrograde' WHEN 2 THEN 'radial' ELSE 'cross-track' END"


@query("b35_manoeuvre_simulation", f"""
WITH c AS (SELECT norad_id, semi_major_axis_km AS a, eccentricity AS e, (norad_id % 30) / 200e0 AS dv, norad_id % 4 AS d FROM catalog), v AS (SELECT *, sqrt({MU} / a) AS v FROM c),
p AS (SELECT *, CASE d WHEN 0 THEN {MU} / pow(v + dv, 2) WHEN 1 THEN {MU} / pow(v - dv, 2) WHEN 2 THEN a ELSE a + dv * 100 END AS b FROM v),
q AS (SELECT *, CASE d WHEN 0 THEN greatest(0, (b - a * (1 - e)) / b) WHEN 1 THEN abs(a * (1 + e) - b) / (b + a * (1 + e)) WHEN 2 THEN greatest(0, e + dv / v * 0.5e0) ELSE e END AS f FROM p),
s AS (SELECT *, a * (1 - e) - {R} AS p0, b * (1 - f) - {R} AS p1 FROM q)
SELECT norad_id, round(p1, 6) AS post_perigee_km, round(b * (1 + f) - {R}, 6) AS post_apogee_km, round(2 * pi() * sqrt(pow(b, 3) / {MU}) / 60, 6) AS post_period_min, round(b - a, 6) + 0e0 AS delta_altitude_km,
  round(greatest(0.001, 500 * (1 - exp(-dv / (300 * 9.80665e0 / 1000)))), 6) AS fuel_kg, p1 >= 200 AS safe, CASE WHEN p1 < 200 THEN 'increased' WHEN p0 < 300 AND p1 > p0 THEN 'decreased' ELSE 'none' END AS reentry_risk,
  CASE WHEN p1 < 200 THEN 'perigee below 200 km' || CASE WHEN dv > 0.1 THEN '; large burn' ELSE '' END WHEN p0 < 300 AND p1 > p0 THEN 'decay risk reduced' || CASE WHEN dv > 0.1 THEN '; large burn' ELSE '' END WHEN dv > 0.1 THEN 'large burn' ELSE 'within limits' END AS notes FROM s""")
def b35(t):
    i = F.col("norad_id")
    out = manoeuvre.simulate(F.col("semi_major_axis_km"), F.col("eccentricity"), i % 30 / 200.0, F.expr(_DIR))
    num = ["post_perigee_km", "post_apogee_km", "post_period_min", "delta_altitude_km", "fuel_kg"]
    return t.catalog.select("norad_id", *[_r(out[k]).alias(k) for k in num], out["safe"].alias("safe"), out["reentry_risk"].alias("reentry_risk"), F.array_join(out["notes"], "; ").alias("notes"))


@query("b36_two_body_forecast")
def b36(t):
    """Every step of all seven days. Objects are dealt out first, as a catalogue of one small file is one task, and each step is
    a row of its own."""
    rows = t.catalog.select("norad_id", "semi_major_axis_km", "eccentricity", "inclination_deg").repartition(max(t.partitions, t.spark.sparkContext.defaultParallelism), "norad_id")
    p = manoeuvre.two_body_at(F.col("semi_major_axis_km"), F.col("eccentricity"), F.col("inclination_deg"), F.col("i"))
    return rows.withColumn("i", F.explode(manoeuvre.forecast_steps())).select("norad_id", p.alias("p")).select("norad_id", "p.*")


@query("b37_avoidance_options", f"""
WITH c AS (SELECT conjunction_id, miss_distance_km AS m, pc, 3600e0 * (conjunction_id % 48) AS dt, 400e0 + conjunction_id % 900 AS h FROM conjunctions),
n AS (SELECT *, sqrt({MU} / pow({R} + h, 3)) AS n, sqrt({MU} / ({R} + h)) AS v, greatest(5, m * 3) AS far, greatest(5, m * 2) AS wide FROM c),
b AS (SELECT *, CASE WHEN dt > 0 THEN greatest(far / (2 * dt) * (n / v), 1e-5) ELSE 0.001 END AS al, least(abs(CASE WHEN abs(sin(n * dt)) > 1e-6 THEN wide * n / sin(n * dt) ELSE wide * n END), 0.01) AS ra, wide * n AS cr, sqrt(m * m + wide * wide) AS side FROM n),
o AS (SELECT conjunction_id, m, pc, 1 AS place, 'along_track_burn' AS option, al AS dv, m + far * 0.8e0 AS nm, h - 2 * al / n * 1000 > 200 AS safe FROM b UNION ALL SELECT conjunction_id, m, pc, 2, 'radial_burn', ra, side, true FROM b UNION ALL SELECT conjunction_id, m, pc, 3, 'cross_track_burn', cr, side, cr < 0.1 FROM b),
k AS (SELECT *, least(pc, pc * pow(m / nm, 2)) AS np FROM o), w AS (SELECT *, row_number() OVER (PARTITION BY conjunction_id ORDER BY safe DESC, safe AND np < 1e-5 DESC, dv, place) AS k FROM k)
SELECT conjunction_id, option, round(dv * 1000, 6) AS dv_ms, round(500 * (1 - exp(-dv / 2.941995e0)), 6) AS fuel_kg, round(nm, 6) AS new_miss_km, CASE WHEN np >= 1e-3 THEN 'red' WHEN np >= 1e-4 THEN 'yellow' WHEN np >= 1e-5 THEN 'green' ELSE 'white' END AS risk, safe, safe AND k = 1 AS recommended FROM w""")
def b37(t):
    c = t.conjunctions
    opts = manoeuvre.avoidance_options(F.col("miss_distance_km"), F.col("pc"), F.lit(3600.0) * (F.col("conjunction_id") % 48), 400.0 + F.col("conjunction_id") % 900)
    rows = c.select("conjunction_id", opts.alias("o")).withColumn("best", manoeuvre.recommended(F.col("o"))["option"]).select("conjunction_id", "best", F.inline("o"))
    return rows.select("conjunction_id", "option", _r("dv_ms").alias("dv_ms"), _r("fuel_kg").alias("fuel_kg"), _r("new_miss_km").alias("new_miss_km"), "risk", "safe", F.col("option").eqNullSafe(F.col("best")).alias("recommended"))


_URL = "CASE page_id % 9 WHEN 0 THEN 'https://www.nasa.gov/a' WHEN 1 THEN 'http://notnasa.gov/x' WHEN 2 THEN 'https://data.esa.int:443/y?q=1' WHEN 3 THEN 'https://celestrak.org' WHEN 4 THEN 'https://mit.edu/p' WHEN 5 THEN 'https://arxiv.org/abs/1' WHEN 6 THEN NULL ELSE url END"


@query("b38_source_tier", f"""
WITH u AS (SELECT page_id, {_URL} AS url FROM pages), h AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '') AS h FROM u)
SELECT page_id, CAST(CASE WHEN h IN ('nasa.gov', 'esa.int') OR ends_with(h, '.nasa.gov') OR ends_with(h, '.esa.int') THEN 1 WHEN h = 'celestrak.org' THEN 2 WHEN ends_with(h, '.edu') OR h = 'arxiv.org' THEN 3 ELSE 6 END AS INTEGER) AS tier FROM h""")
def b38(t):
    return t.pages.select("page_id", ids.source_tier(F.expr(_URL)).alias("tier"))


@query("b39_aqid", """
WITH s AS (SELECT s_suppkey, 'AQID-COMPANY-' || trim(regexp_replace(upper(s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' (Ltd.)' ELSE '' END), '[^A-Z0-9]+', '-', 'g'), '-') AS aqid FROM supplier)
SELECT s_suppkey, aqid, true AS valid, 'COMPANY' AS class FROM s""")
def b39(t):
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " (Ltd.)").otherwise(""))
    rows = t.supplier.select("s_suppkey", ids.aqid(F.lit("COMPANY"), name).alias("aqid"))
    return rows.select("*", ids.aqid_valid(F.col("aqid")).alias("valid"), ids.aqid_class(F.col("aqid")).alias("class"))


_ST = "CASE source % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'news' WHEN 2 THEN 'peer_reviewed' ELSE 'forum' END"
_VS = "CASE field % 3 WHEN 0 THEN 'authoritative' WHEN 1 THEN 'unverified' ELSE 'disputed' END"
_AU = f"CASE {_ST} WHEN 'official' THEN 1e0 WHEN 'news' THEN 0.65e0 WHEN 'peer_reviewed' THEN 0.85e0 ELSE 0.5e0 END"
_VE = f"CASE {_VS} WHEN 'authoritative' THEN 1e0 WHEN 'unverified' THEN 0.5e0 ELSE 0.3e0 END"


@query("b40_confidence", f"SELECT aqid, field, source, fact_id, round({_AU} * 0.4e0 + {_VE} * 0.35e0 + CAST(confidence AS DOUBLE) * 0.25e0, 4) AS composite FROM facts")
def b40(t):
    return t.facts.select("aqid", "field", "source", "fact_id", ids.composite_confidence(F.expr(_ST), F.expr(_VS), F.col("confidence").cast("double")).alias("composite"))


@query("b40_entity_confidence", f"SELECT aqid, round(max({_AU}) * 0.4e0 + 0.5e0 * 0.35e0 + CASE count(DISTINCT source) WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.7e0 ELSE 0.9e0 END * 0.25e0, 4) AS confidence FROM facts GROUP BY aqid")
def b40_entity(t):
    best = t.facts.groupBy("aqid").agg(F.max(ids.lookup(F.expr(_ST), ids.AUTHORITY, 0.5)).alias("a"), F.count_distinct("source").alias("n"))
    return best.select("aqid", ids.entity_confidence(F.col("a"), F.lit("unverified"), F.col("n")).alias("confidence"))


@query("b41_completeness", "SELECT mission_id, round((CAST(name <> '' AS INTEGER) + CAST(agency IS NOT NULL AS INTEGER) + CAST(budget_musd IS NOT NULL AS INTEGER) + CAST(launch_year IS NOT NULL AS INTEGER)) / 4e0, 4) AS completeness FROM missions")
def b41(t):
    return t.missions.select("mission_id", ids.completeness([F.col(c) for c in ("name", "agency", "budget_musd", "launch_year")]).alias("completeness"))


@query("b42_version_bump", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '1.' || CAST(l_partkey % 10 AS VARCHAR) || '.' || CAST(l_linenumber + 1 AS VARCHAR) AS version FROM lineitem")
def b42(t):
    v = F.concat_ws(".", F.lit("1"), F.col("l_partkey") % 10, "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ids.bump_version(v).alias("version"))


@query("b43_entity_class", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'COMPANY' WHEN 1 THEN 'GOV_AGENCY' WHEN 2 THEN 'LAUNCH_VEHICLE' WHEN 3 THEN 'AGREEMENT' END AS class FROM part")
def b43(t):
    i = F.col("p_partkey") % 5
    raw = F.when(i == 0, " Startup").when(i == 1, "Space Agency").when(i == 2, "rocket").when(i == 3, "TREATY ").otherwise("moon")
    return t.part.select("p_partkey", ids.entity_class(raw).alias("class"))


@query("b44_cdm_document", """
SELECT conjunction_id, '{"MESSAGE_ID":"' || CAST(conjunction_id AS VARCHAR) || '","MISS_DISTANCE":' || CAST(round(miss_distance_km * 1000, 2) AS VARCHAR) || ',"RELATIVE_SPEED":' || CAST(round(relative_velocity_kms * 1000, 3) AS VARCHAR)
  || ',"RISK_LEVEL":"' || CASE WHEN pc >= 1e-3 THEN 'RED' WHEN pc >= 1e-4 THEN 'YELLOW' WHEN pc >= 1e-5 THEN 'GREEN' ELSE 'WHITE' END || '","OBJECT1":{"OBJECT":"OBJECT1","OBJECT_DESIGNATOR":"' || CAST(primary_norad AS VARCHAR) || '"},"OBJECT2":{"OBJECT":"OBJECT2","OBJECT_DESIGNATOR":"' || CAST(secondary_norad AS VARCHAR) || '"}}' AS cdm FROM conjunctions""")
def b44(t):
    member = lambda i, c: F.struct(F.lit(f"OBJECT{i}").alias("OBJECT"), F.col(c).cast("string").alias("OBJECT_DESIGNATOR")).alias(f"OBJECT{i}")
    doc = F.struct(
        F.col("conjunction_id").cast("string").alias("MESSAGE_ID"), F.round(F.col("miss_distance_km") * 1000, 2).alias("MISS_DISTANCE"), F.round(F.col("relative_velocity_kms") * 1000, 3).alias("RELATIVE_SPEED"),
        F.upper(orbit.risk_band(F.col("pc"))).alias("RISK_LEVEL"), member(1, "primary_norad"), member(2, "secondary_norad"),
    )
    return t.conjunctions.select("conjunction_id", F.to_json(doc).alias("cdm"))


@query("b45_manoeuvre_urgency", f"""
WITH h AS (SELECT conjunction_id, CASE WHEN maneuver_required THEN (epoch_us(tca) - epoch_us(TIMESTAMP '2000-01-01')) / 3600e6 END AS h FROM conjunctions)
SELECT conjunction_id, round(h, 1) AS hours, CASE WHEN h IS NULL THEN 'MONITOR' WHEN h < 6 THEN 'CRITICAL' WHEN h < 24 THEN 'HIGH' ELSE 'ELEVATED' END AS urgency FROM h""")
def b45(t):
    hours = F.when(F.col("maneuver_required"), F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'"), F.col("tca")) / 3600e6)
    return t.conjunctions.select("conjunction_id", F.round(hours, 1).alias("hours"), F.when(hours.isNull(), "MONITOR").when(hours < 6, "CRITICAL").when(hours < 24, "HIGH").otherwise("ELEVATED").alias("urgency"))


@query("b46_summary_projection", "SELECT conjunction_id, primary_norad, secondary_norad, CAST(tca AS DATE) AS tca_day, round(miss_distance_km * 1000, 1) AS miss_m, upper(status) AS status FROM conjunctions")
def b46(t):
    return t.conjunctions.select("conjunction_id", "primary_norad", "secondary_norad", F.to_date("tca").alias("tca_day"), F.round(F.col("miss_distance_km") * 1000, 1).alias("miss_m"), F.upper("status").alias("status"))


@query("b47_safety_gate", """
WITH r AS (SELECT conjunction_id, primary_norad, pc, (conjunction_id % 25) / 1000e0 AS dv, tca < TIMESTAMP '1998-01-01' AS late FROM conjunctions)
SELECT conjunction_id, concat_ws(';', CASE WHEN dv > 0.010 THEN 'large burn' END, CASE WHEN pc < 1e-4 THEN 'low probability' END, CASE WHEN late THEN 'window passed' END, CASE WHEN pc >= 1e-3 THEN 'collision red' END) AS flags, dv <= 0.010 AND pc >= 1e-4 AND NOT late AS approved FROM r""")
def b47(t):
    dv, pc, late = F.col("conjunction_id") % 25 / 1000.0, F.col("pc"), F.col("tca") < F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    flags = F.concat_ws(";", F.when(dv > 0.010, "large burn"), F.when(pc < 1e-4, "low probability"), F.when(late, "window passed"), F.when(pc >= 1e-3, "collision red"))
    return t.conjunctions.select("conjunction_id", flags.alias("flags"), ((dv <= 0.010) & (pc >= 1e-4) & ~late).alias("approved"))


@query("b49_map_feed", f"""
SELECT norad_id, round(degrees(asin(z / sqrt(x*x + y*y + z*z))), 4) AS lat, round(degrees(atan2(y, x)), 4) AS lon, round(sqrt(x*x + y*y + z*z) - {R}, 2) AS alt_km, round(sqrt(vx*vx + vy*vy + vz*vz), 3) AS speed, list_transform([x, y, z], lambda v: round(v, 1)) AS pos
FROM states WHERE sqrt(x*x + y*y + z*z) - {R} BETWEEN 450 AND 2000 ORDER BY norad_id LIMIT 10000""")
def b49(t):
    """The feed's limit of 10,000 objects is part of it."""
    s = frames.spherical(_p())
    rows = t.states.where(s["alt_km"].between(450, 2000)).orderBy("norad_id").limit(10_000)
    return rows.select("norad_id", F.round(s["lat_deg"], 4).alias("lat"), F.round(s["lon_deg"], 4).alias("lon"), F.round(s["alt_km"], 2).alias("alt_km"), F.round(frames.norm(_v()), 3).alias("speed"), F.transform(F.array(*_p()), lambda v: F.round(v, 1)).alias("pos"))


#: Keywords of fragmentation events and constellations, and the agents of each intent.
FRAGMENTATION = {"fengyun": "FRAG-FY1C-2007", "iridium 33": "FRAG-IRIDIUM33-2009", "cosmos 2251": "FRAG-COSMOS2251-2009", "asat": "FRAG-ASAT-2019"}
CONSTELLATIONS = ["starlink", "oneweb", "kuiper", "gps", "galileo", "glonass", "navic"]
ROUTES = {
    "collision_risk": ["conjunction_analysis", "space_debris", "orbital_dynamics", "space_weather"], "orbital_decay": ["space_debris", "orbital_dynamics", "space_weather"],
    "maneuver_planning": ["conjunction_analysis", "mission_planning", "orbital_dynamics"], "mission_planning": ["mission_planning", "orbital_dynamics", "space_weather"],
    "space_weather": ["space_weather", "orbital_dynamics"], "satellite_profile": ["satellite_intelligence", "orbital_dynamics"], "debris_analysis": ["space_debris", "orbital_dynamics", "space_weather"],
    "research_question": ["aerospace_research"], "pass_prediction": ["orbital_dynamics", "satellite_intelligence"], "general_ssa": ["orbital_dynamics", "conjunction_analysis", "space_debris", "satellite_intelligence"],
}


@query("b50_keyword_routing", """
WITH c AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Fengyun debris at 865 km' WHEN 1 THEN 'Is STARLINK near Cosmos 2251?' WHEN 2 THEN 'GPS at 20200km' WHEN 3 THEN 'asat test' WHEN 4 THEN 'hello' ELSE text END AS q, CASE (conv_id + turn) % 3 WHEN 0 THEN 'space_weather' WHEN 1 THEN 'pass_prediction' ELSE 'research_question' END AS intent FROM conversations),
r(intent, agents) AS (VALUES ('space_weather', ['space_weather', 'orbital_dynamics']), ('pass_prediction', ['orbital_dynamics', 'satellite_intelligence']), ('research_question', ['aerospace_research']))
SELECT conv_id, turn, CASE WHEN contains(lower(q), 'fengyun') THEN 'FRAG-FY1C-2007' WHEN contains(lower(q), 'iridium 33') THEN 'FRAG-IRIDIUM33-2009' WHEN contains(lower(q), 'cosmos 2251') THEN 'FRAG-COSMOS2251-2009' WHEN contains(lower(q), 'asat') THEN 'FRAG-ASAT-2019' END AS fragmentation,
  CASE WHEN contains(lower(q), 'starlink') THEN 'STARLINK' WHEN contains(lower(q), 'gps') THEN 'GPS' END AS constellation, CAST(coalesce(nullif(regexp_extract(q, '([0-9]+)\\s*km', 1), ''), '550') AS DOUBLE) AS altitude_km, unnest(agents) AS agent FROM c JOIN r USING (intent)""")
def b50(t):
    q = F.expr("CASE (conv_id + turn) % 6 WHEN 0 THEN 'Fengyun debris at 865 km' WHEN 1 THEN 'Is STARLINK near Cosmos 2251?' WHEN 2 THEN 'GPS at 20200km' WHEN 3 THEN 'asat test' WHEN 4 THEN 'hello' ELSE text END")
    i = (F.col("conv_id") + F.col("turn")) % 3
    intent = F.when(i == 0, "space_weather").when(i == 1, "pass_prediction").otherwise("research_question")
    rows = t.conversations.select("conv_id", "turn", q.alias("q"), intent.alias("intent")).withColumn("low", F.lower("q"))
    first = lambda table: F.coalesce(*[F.when(F.col("low").contains(k), v) for k, v in table.items()])
    routes = t.spark.createDataFrame([(k, a) for k, v in ROUTES.items() for a in v], "intent string, agent string")
    altitude = F.coalesce(F.nullif(F.regexp_extract("q", r"([0-9]+)\s*km", 1), F.lit("")), F.lit("550")).cast("double")
    rows = rows.select("conv_id", "turn", "intent", first(FRAGMENTATION).alias("fragmentation"), first({c: c.upper() for c in CONSTELLATIONS}).alias("constellation"), altitude.alias("altitude_km"))
    return rows.join(F.broadcast(routes), "intent").drop("intent")


@query("flagship_country_risk", """
SELECT k.country, count(*) AS conjunctions, count(DISTINCT k.norad_id) AS objects, count(*) FILTER (c.pc >= 1e-3) AS red, count(*) FILTER (c.pc >= 1e-4 AND c.pc < 1e-3) AS yellow, count(*) FILTER (c.maneuver_required) AS manoeuvres, max(c.pc) AS max_pc,
  count(*) FILTER (k.perigee_km < 2000) AS low_orbit FROM catalog k JOIN conjunctions c ON c.primary_norad = k.norad_id GROUP BY k.country""")
def flagship(t):
    """Risk profile of each country's catalogue: regime and risk classified, joined with conjunctions, aggregated once."""
    c = t.conjunctions.withColumn("risk", orbit.risk_band(F.col("pc")))
    joined = t.catalog.select("norad_id", "country", "perigee_km").join(c, F.col("norad_id") == F.col("primary_norad"))
    n = lambda cond: F.count_if(cond)
    return joined.groupBy("country").agg(
        F.count(F.lit(1)).alias("conjunctions"), F.count_distinct("norad_id").alias("objects"), n(F.col("risk") == "red").alias("red"), n(F.col("risk") == "yellow").alias("yellow"),
        n(F.col("maneuver_required")).alias("manoeuvres"), F.max("pc").alias("max_pc"), n(F.col("perigee_km") < 2000).alias("low_orbit"),
    )
