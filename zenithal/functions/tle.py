"""Two-line element sets as column expressions: checksum, packed decimals, epochs, fields and their checks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from zenithal.functions.orbit import EARTH_RADIUS_KM, semi_major_axis


def checksum(line: Column) -> Column:
    """Sum of the digits of the first 68 characters, a minus counting 1, modulo 10."""
    marks = F.split(F.regexp_replace(F.substring(line, 1, 68), "[^0-9-]", ""), "")
    return F.aggregate(F.filter(marks, lambda c: c != ""), F.lit(0), lambda a, c: a + F.when(c == "-", 1).otherwise(c.try_cast("int"))) % 10


def packed_decimal(field: Column) -> Column:
    """``±ddddd±e`` as ±0.ddddd * 10**e; 0.0 for anything else."""
    t = F.trim(field)
    part = lambda i: F.regexp_extract(t, r"^([+-]*)([0-9]+)([+-][0-9]+)$", i)
    value = F.concat(F.lit("0."), part(2)).try_cast("double") * F.pow(F.lit(10.0), part(3).try_cast("double"))
    return F.coalesce(F.when(part(1).startswith("-"), -value).otherwise(value), F.lit(0.0))


def epoch(year2: Column, day: Column) -> Column:
    """Two-digit year (57 to 99: last century) and day of the year from 1.0, to the microsecond, as a timestamp without zone."""
    year = year2 + F.when(year2 < 57, 2000).otherwise(1900)
    micros = F.round((day - 1) * 86_400_000_000).cast("long")
    start = F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.timestamp_add("MICROSECOND", micros, start)


def fields(line1: str = "line1", line2: str = "line2") -> dict[str, Column]:
    """All fields of an element set and what follows from them; null where a field can't be read."""
    a, b = F.trim(F.col(line1)), F.trim(F.col(line2))
    cut = lambda x, i, n: F.trim(F.substring(x, i, n))
    num, whole = (lambda c: c.try_cast("double")), (lambda c: c.try_cast("int"))
    n = num(cut(b, 53, 11))
    e = num(F.concat(F.lit("0."), cut(b, 27, 7)))
    axis = semi_major_axis(F.when(n > 0, n))
    year2 = whole(cut(a, 19, 2))
    year = year2 + F.when(year2 < 57, 2000).otherwise(1900)
    return {
        "norad_id": whole(cut(a, 3, 5)), "norad_id_2": whole(cut(b, 3, 5)), "classification": F.substring(a, 8, 1), "intl_designator": cut(a, 10, 8),
        "epoch_year": whole(cut(a, 19, 2)), "epoch_day": num(cut(a, 21, 12)), "days_1950": 365 * (year - 1950) + F.floor((year - 1949) / 4) + num(cut(a, 21, 12)), "n_dot": num(cut(a, 34, 10)), "n_ddot": packed_decimal(F.substring(a, 45, 8)), "bstar": packed_decimal(F.substring(a, 54, 8)),
        "element_set_num": F.coalesce(whole(cut(a, 65, 4)), F.lit(0)), "inclination_deg": num(cut(b, 9, 8)), "raan_deg": num(cut(b, 18, 8)), "eccentricity": e,
        "arg_perigee_deg": num(cut(b, 35, 8)), "mean_anomaly_deg": num(cut(b, 44, 8)), "mean_motion_rev_day": n, "rev_number": F.coalesce(whole(cut(b, 64, 5)), F.lit(0)),
        "semi_major_axis_km": axis, "perigee_km": axis * (1 - e) - EARTH_RADIUS_KM, "apogee_km": axis * (1 + e) - EARTH_RADIUS_KM, "period_min": F.when(n > 0, 1440.0 / n),
    }


def errors(line1: str = "line1", line2: str = "line2") -> Column:
    """What is wrong with an element set, first things first; an empty array for a valid one."""
    a, b, f = F.trim(F.col(line1)), F.trim(F.col(line2)), fields(line1, line2)
    stored = lambda x: F.substring(x, 69, 1).try_cast("int")
    short = F.coalesce((F.length(a) < 69) | (F.length(b) < 69), F.lit(True))  # missing lines, too
    tests = [
        ("length", short), ("line number", ~short & ~(a.startswith("1") & b.startswith("2"))),
        ("checksum 1", ~short & ~checksum(a).eqNullSafe(stored(a))), ("checksum 2", ~short & ~checksum(b).eqNullSafe(stored(b))),
        ("norad mismatch", ~short & ~f["norad_id"].eqNullSafe(f["norad_id_2"])),
        ("inclination", ~short & ~F.coalesce(f["inclination_deg"].between(0, 180), F.lit(False))),
        ("eccentricity", ~short & ~F.coalesce((f["eccentricity"] >= 0) & (f["eccentricity"] < 1), F.lit(False))),
        ("mean motion", ~short & ~F.coalesce(f["mean_motion_rev_day"] > 0, F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]))


def age_check(epoch_col: Column, as_of: Column, least_days: float = -1.0, most_days: float = 30.0, fresh_days: float = 7.0) -> dict[str, Column]:
    """Age in days at ``as_of``, whether it is allowed, and whether it is fresh enough to propagate."""
    age = F.timestamp_diff("MICROSECOND", epoch_col, as_of) / (86_400 * 1e6)
    return {"age_days": age, "age_ok": age.between(least_days, most_days), "fresh": age <= fresh_days}


def mean_motion(axis_km: Column, mu: float = 398600.4418) -> Column:
    """Revolutions a day of a semi-major axis."""
    return F.sqrt(mu / F.pow(axis_km, 3.0)) * (86400.0 / (2 * math.pi))
