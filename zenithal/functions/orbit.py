"""Orbits: derived elements, regimes, plausibility, atmosphere and decay, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth's radius (km), gravitational parameter (km3/s2), second harmonic, rotation (rad/s), flattening.
EARTH_RADIUS_KM, MU, J2, EARTH_ROTATION, FLATTENING = 6378.137, 398600.4418, 1.08262668e-3, 7.2921150e-5, 1 / 298.257223563
#: Altitude band (km), scale height (km), density in the middle of the band (kg/m3).
ATMOSPHERE = [
    (0, 100, 8.5, 1.225), (100, 200, 6.0, 5.6e-7), (200, 300, 7.0, 2.5e-10), (300, 400, 8.0, 1.9e-11), (400, 500, 8.5, 6.0e-12), (500, 600, 9.5, 1.6e-12),
    (600, 700, 10.0, 4.5e-13), (700, 800, 10.5, 1.3e-13), (800, 900, 11.0, 3.9e-14), (900, 1000, 11.5, 1.2e-14), (1000, 2000, 14.0, 3.5e-15),
]


def semi_major_axis(rev_per_day: Column) -> Column:
    return F.pow(MU / F.pow(rev_per_day * (2 * math.pi / 86400.0), 2.0), 1 / 3)


def precession_deg_day(axis: Column, e: Column, inc_deg: Column) -> Column:
    """Drift of the node by J2."""
    n = F.sqrt(MU / F.pow(axis, 3.0))
    return F.degrees(-1.5 * n * J2 * F.pow(EARTH_RADIUS_KM / axis, 2.0) * F.cos(F.radians(inc_deg)) / F.pow(1 - e * e, 2.0)) * 86400


def regime_from_elements(axis: Column, e: Column, inc: Column) -> Column:
    """Struct (regime, confidence, sub_type, sso, geo_belt) by ordered rules; what is eccentric is HEO before a transfer orbit
    is looked for, so GTO is never the answer."""
    perigee, apogee, altitude = axis * (1 - e) - EARTH_RADIUS_KM, axis * (1 + e) - EARTH_RADIUS_KM, axis - EARTH_RADIUS_KM
    period = 2 * math.pi * F.sqrt(F.pow(axis, 3.0) / MU) / 60
    sun = (F.abs(precession_deg_day(axis, e, inc) - 0.98561) < 0.05) & (inc > 80) & (inc < 115)
    critical = (inc > 62) & (inc < 65)
    heo = F.when(critical & (period > 700) & (period < 760), "Molniya").when(critical & (period > 1400) & (period < 1460), "Tundra")
    gps = F.when((inc > 55) & (inc < 57) & (period > 660) & (period < 690), "GPS-like")
    belt = F.abs(altitude - 35786.0)
    text = lambda x: (F.lit(x) if isinstance(x, str) else F.lit(None).cast("string") if x is None else x)
    made = lambda regime, sure, sub=None, sso=False, geo=False: F.struct(F.lit(regime).alias("regime"), F.lit(sure).alias("confidence"), text(sub).alias("sub_type"), F.lit(sso).alias("sso"), F.lit(geo).alias("geo_belt"))
    return (
        F.when(apogee > 300_000, made("DSO", 0.99, "Deep space")).when(apogee > 100_000, made("TLI", 0.95)).when(e > 0.25, made("HEO", 0.97, heo))
        .when((perigee < 2000) & (apogee > 30_000) & (e > 0.5), made("GTO", 0.93)).when((belt < 200) & (e < 0.01) & (inc < 2), made("GEO", 0.98, "Geostationary", geo=True))
        .when((belt < 500) & (e < 0.05), made("GEO", 0.85, "Near-GEO")).when(altitude > 2000, made("MEO", 0.95, gps)).when(sun, made("SSO", 0.97, "Sun-sync LEO", sso=True))
        .when(altitude < 450, made("VLEO", 0.96)).otherwise(made("LEO", 0.95))
    )


def regime_from_altitude(altitude: Column, inc: Column) -> Column:
    out = F.when(altitude < 0, "UNKNOWN").when(altitude < 450, "VLEO").when((altitude < 2000) & inc.between(96, 100), "SSO").when(altitude < 2000, "LEO")
    return out.when(altitude < 35000, "MEO").when(altitude <= 36500, "GEO").when(altitude > 36500, "HEO").otherwise("UNKNOWN")


def regime_stored_or_computed(stored: Column, perigee: Column, apogee: Column, inc: Column) -> Column:
    """The stored regime in upper case; where it is missing or empty, the one of the mean altitude."""
    mean = (perigee + apogee) / 2
    return F.when(F.coalesce(F.length(stored), F.lit(0)) > 0, F.upper(stored)).when(mean.isNull(), "UNKNOWN").otherwise(regime_from_altitude(mean, F.coalesce(inc, F.lit(0.0))))


def object_type(raw: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(raw, F.lit("unknown"))))
    return F.when(t.isin("satellite", "payload"), "PAYLOAD").when(t == "debris", "DEBRIS").when(t.isin("rocket_body", "r/b", "rocket body"), "ROCKET_BODY").otherwise("UNKNOWN")


def plausible(position: list[Column], velocity: list[Column]) -> Column:
    """0 for a state between 80 and 400,000 km of altitude at 0.5 to 12 km/s with finite numbers, else 99."""
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    finite = F.lit(True)
    for c in position + velocity:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = (length(position) - EARTH_RADIUS_KM).between(80.0, 400_000.0) & length(velocity).between(0.5, 12.0)
    return F.when(finite & F.coalesce(ok, F.lit(False)), 0).otherwise(99)


def density(altitude: Column, f107: Column) -> Column:
    """Air density in kg/m3: exponential within bands, times a factor of solar flux that is at least a half."""
    factor = F.greatest(F.lit(0.5), 1.0 + 0.012 * (f107 - 150.0))
    out = F.when(altitude <= 0, F.lit(1.225))
    for low, high, scale, rho in ATMOSPHERE:
        out = out.when((altitude >= low) & (altitude < high), rho * F.exp(-(altitude - (low + high) / 2) / scale) * factor)
    return out.otherwise(F.lit(3.5e-15))


def decay_km_day(axis: Column, e: Column, bstar: Column, f107: Column) -> Column:
    """Change of the semi-major axis by drag, negative for decay."""
    speed = F.sqrt(MU / F.pow(axis, 3.0)) * axis * 1000.0
    area = F.when(F.abs(bstar) > 1e-10, 2.0 * bstar * (EARTH_RADIUS_KM * 1000.0) / 2.461e-5).otherwise(2.2e-3)
    return -density(axis - EARTH_RADIUS_KM, f107) * area * speed * speed * (1 + 1.5 * e * e) / 1000.0 * 86400.0


def risk_band(pc: Column) -> Column:
    return F.when(pc >= 1e-3, "red").when(pc >= 1e-4, "yellow").when(pc >= 1e-5, "green").otherwise("white")
