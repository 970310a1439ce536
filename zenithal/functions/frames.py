"""Time scales and reference frames as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.functions.orbit import EARTH_RADIUS_KM, EARTH_ROTATION, FLATTENING

E2 = 2 * FLATTENING - FLATTENING**2
POLAR_RADIUS_KM = EARTH_RADIUS_KM * (1 - FLATTENING)
Vector = list[Column]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.make_timestamp_ntz(*[F.lit(x) for x in (1970, 1, 1, 0, 0, 0)]), ts)


def julian_date(ts: Column) -> tuple[Column, Column]:
    """(day, fraction): the day is a multiple of a half, the fraction lies in [0, 1)."""
    us = micros(ts)
    day = F.floor(us / 86_400_000_000)
    return day + 2440587.5, (us - day * 86_400_000_000) / 86_400_000_000.0


def from_julian(day: Column, fraction: Column) -> Column:
    us = F.round((day - 2440587.5) * 86_400_000_000 + fraction * 86_400_000_000).cast("long")
    return F.timestamp_add("MICROSECOND", us, F.make_timestamp_ntz(*[F.lit(x) for x in (1970, 1, 1, 0, 0, 0)]))


def julian_valid(day: Column, fraction: Column) -> Column:
    """Years 1957 to 2100, and a fraction in [0, 1)."""
    return day.between(2435839.5, 2488069.5) & (fraction >= 0) & (fraction < 1)


def gmst(ts: Column) -> Column:
    """Greenwich mean sidereal time in radians, IAU 1982; the sign is that of the angle."""
    t = (micros(ts) - 946_728_000_000_000) / 86_400_000_000.0 / 36525.0
    seconds = 67310.54841 + (876600.0 * 3600.0 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t
    return (seconds * (2 * math.pi / 86400.0)) % F.lit(2 * math.pi)


def simple_angle(ts: Column) -> Column:
    """Rotation since J2000 without its offset, as the live map uses it."""
    return F.pmod(EARTH_ROTATION * ((micros(ts) - 946_728_000_000_000) / 1e6), F.lit(2 * math.pi))


def rotate(p: Vector, angle: Column) -> Vector:
    """Inertial to Earth-fixed."""
    c, s = F.cos(angle), F.sin(angle)
    return [c * p[0] + s * p[1], c * p[1] - s * p[0], p[2]]


def teme_to_eci(p: Vector, v: Vector, angle: Column) -> tuple[Vector, Vector]:
    """Rotation back by the angle, less the speed that Earth's rotation adds."""
    c, s = F.cos(angle), F.sin(angle)
    turn = lambda a: [c * a[0] - s * a[1], s * a[0] + c * a[1], a[2]]
    q, w = turn(p), turn(v)
    return q, [w[0] + EARTH_ROTATION * q[1], w[1] - EARTH_ROTATION * q[0], w[2]]


def geodetic(p: Vector, rounds: int = 3) -> dict[str, Column]:
    """Earth-fixed position (km) to latitude, longitude (degrees) and height above the ellipsoid (km)."""
    x, y, z = p
    flat = F.sqrt(x * x + y * y)
    theta = F.atan2(z * EARTH_RADIUS_KM, flat * POLAR_RADIUS_KM)
    bulge = (EARTH_RADIUS_KM**2 - POLAR_RADIUS_KM**2) / POLAR_RADIUS_KM
    lat = F.atan2(z + bulge * F.pow(F.sin(theta), 3.0), flat - E2 * EARTH_RADIUS_KM * F.pow(F.cos(theta), 3.0))
    curve = lambda a: EARTH_RADIUS_KM / F.sqrt(1 - E2 * F.sin(a) * F.sin(a))
    for _ in range(rounds):
        lat = F.atan2(z + E2 * curve(lat) * F.sin(lat), flat)
    height = F.when(F.abs(F.cos(lat)) > 1e-10, flat / F.cos(lat) - curve(lat)).otherwise(F.abs(z) / F.abs(F.sin(lat)) - curve(lat) * (1 - E2))
    return {"lat_deg": F.degrees(lat), "lon_deg": F.degrees(F.atan2(y, x)), "alt_km": height}


def add_geodetic(df: DataFrame, xyz: tuple[str, str, str], rounds: int = 3) -> DataFrame:
    """``df`` plus lat_deg, lon_deg and alt_km of Earth-fixed columns. The same rounds as :func:`geodetic`, each a column of its
    own, so that the expression of a round isn't repeated in the next one: for columns that are long expressions themselves."""
    x, y, z = map(F.col, xyz)
    flat, lat = F.col("_flat"), F.col("_lat")
    theta = F.atan2(z * EARTH_RADIUS_KM, flat * POLAR_RADIUS_KM)
    bulge = (EARTH_RADIUS_KM**2 - POLAR_RADIUS_KM**2) / POLAR_RADIUS_KM
    curve = EARTH_RADIUS_KM / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    out = df.withColumn("_flat", F.sqrt(x * x + y * y)).withColumn("_theta", theta)
    out = out.withColumn("_lat", F.atan2(z + bulge * F.pow(F.sin("_theta"), 3.0), flat - E2 * EARTH_RADIUS_KM * F.pow(F.cos("_theta"), 3.0)))
    for _ in range(rounds):
        out = out.withColumn("_lat", F.atan2(z + E2 * curve * F.sin(lat), flat))
    height = F.when(F.abs(F.cos(lat)) > 1e-10, flat / F.cos(lat) - curve).otherwise(F.abs(z) / F.abs(F.sin(lat)) - curve * (1 - E2))
    return out.withColumns({"lat_deg": F.degrees(lat), "lon_deg": F.degrees(F.atan2(y, x)), "alt_km": height}).drop("_flat", "_theta", "_lat")


def spherical(p: Vector) -> dict[str, Column]:
    r = norm(p)
    return {"lat_deg": F.when(r > 0, F.degrees(F.asin(p[2] / r))).otherwise(0.0), "lon_deg": F.degrees(F.atan2(p[1], p[0])), "alt_km": r - EARTH_RADIUS_KM}


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def lvlh(rc: Vector, vc: Vector, rd: Vector, vd: Vector) -> tuple[Vector, Vector]:
    """Position and velocity of a deputy in the rotating frame (radial, along track, cross track) of a chief."""
    h = cross(rc, vc)
    unit = lambda v: [x / norm(v) for x in v]
    up, out = unit(rc), unit(h)
    axes = [up, cross(out, up), out]
    dr, dv = [a - b for a, b in zip(rd, rc, strict=True)], [a - b for a, b in zip(vd, vc, strict=True)]
    pos, vel = [dot(q, dr) for q in axes], [dot(q, dv) for q in axes]
    turn = norm(h) / dot(rc, rc)
    spin = cross([turn * x for x in out], pos)
    return pos, [a - b for a, b in zip(vel, spin, strict=True)]


def look_angles(p: Vector, lat_deg: float, lon_deg: float, alt_km: float, angle: Column) -> dict[str, Column]:
    """Azimuth, elevation (degrees) and range (km) of an inertial position from a site."""
    lat, lon = math.radians(lat_deg), math.radians(lon_deg)
    n = EARTH_RADIUS_KM / math.sqrt(1 - E2 * math.sin(lat) ** 2)
    site = [(n + alt_km) * math.cos(lat) * math.cos(lon), (n + alt_km) * math.cos(lat) * math.sin(lon), (n * (1 - E2) + alt_km) * math.sin(lat)]
    d = [a - b for a, b in zip(rotate(p, angle), site, strict=True)]
    south = math.sin(lat) * math.cos(lon) * d[0] + math.sin(lat) * math.sin(lon) * d[1] - math.cos(lat) * d[2]
    east = -math.sin(lon) * d[0] + math.cos(lon) * d[1]
    zenith = math.cos(lat) * math.cos(lon) * d[0] + math.cos(lat) * math.sin(lon) * d[1] + math.sin(lat) * d[2]
    far = norm(d)
    return {"azimuth_deg": F.pmod(F.degrees(F.atan2(-south, east)), F.lit(360.0)), "elevation_deg": F.degrees(F.asin(zenith / far)), "range_km": far}


def j2_velocity(p: Vector, v: Vector, mu: float = 398600.4418, j2: float = 1.08262668355e-3) -> Vector:
    """Velocity after a second of the acceleration by J2; unchanged from 2000 km of altitude up."""
    r = norm(p)
    k, c = 1.5 * j2 * EARTH_RADIUS_KM**2 / F.pow(r, 5.0) * mu, 5.0 * p[2] * p[2] / (r * r)
    return [F.when(r - EARTH_RADIUS_KM < 2000.0, w + k * x * (c - m)).otherwise(w) for w, x, m in zip(v, p, (1.0, 1.0, 3.0), strict=True)]
