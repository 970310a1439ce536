"""Propagation of element sets (SGP4 of the published report and its deep-space part, WGS-72 constants), re-entry, forecasts.

The model is numpy over whole Arrow batches; Spark makes the (object, epoch) rows and deals them out. Sets with a period of
225 minutes or more take the terms of ``deepspace``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.functions import orbit, tle
from zenithal.functions.frames import micros
from zenithal.operators import deepspace
from zenithal.session import ship

#: WGS-72.
RE, MU72, J2, J3, J4 = 6378.135, 398600.8, 0.001082616, -0.00000253881, -0.00000165597
XKE = 60.0 / math.sqrt(RE**3 / MU72)
STATE = "struct<error:int,x:double,y:double,z:double,vx:double,vy:double,vz:double>"
ELEMENTS = ["mean_motion_rev_day", "eccentricity", "inclination_deg", "raan_deg", "arg_perigee_deg", "mean_anomaly_deg", "bstar", "days_1950"]


def _drag(n, e, i, argp, m0, b) -> dict:
    """What of the model does not depend on time."""
    e2, cosi, sini = 1 - e * e, np.cos(i), np.sin(i)
    root, c2 = np.sqrt(e2), cosi * cosi
    a1 = (XKE / n) ** (2 / 3)
    d1 = 0.75 * J2 * (3 * c2 - 1) / (root * e2)
    d = d1 / a1**2
    d = d1 / (a1 * (1 - d * d - d * (1 / 3 + 134 * d * d / 81))) ** 2
    n = n / (1 + d)
    a = (XKE / n) ** (2 / 3)
    con42, con41 = 1 - 5 * c2, 3 * c2 - 1
    perigee = (a * (1 - e) - 1) * RE
    s_km = np.where(perigee < 98, 20.0, np.where(perigee < 156, perigee - 78, 78.0))
    q4 = ((120 - s_km) / RE) ** 4
    s = s_km / RE + 1
    inv = 1 / (a * e2) ** 2
    tsi = 1 / (a - s)
    eta = a * e * tsi
    eta2, ee = eta * eta, e * eta
    psi = np.abs(1 - eta2)
    coef = q4 * tsi**4
    coef1 = coef / psi**3.5
    c1 = b * coef1 * n * (a * (1 + 1.5 * eta2 + ee * (4 + eta2)) + 0.375 * J2 * tsi / psi * con41 * (8 + 3 * eta2 * (8 + eta2)))
    safe_e = np.where(e > 1e-4, e, 1.0)
    c3 = np.where(e > 1e-4, -2 * coef * tsi * (J3 / J2) * n * sini / safe_e, 0.0)
    x1 = 1 - c2
    c4 = 2 * n * coef1 * a * e2 * (eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2) - J2 * tsi / (a * psi) * (-3 * con41 * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * x1 * (2 * eta2 - ee * (1 + eta2)) * np.cos(2 * argp)))
    c5 = 2 * coef1 * a * e2 * (1 + 2.75 * (eta2 + ee) + ee * eta2)
    t1 = 1.5 * J2 * inv * n
    t2, t3 = 0.5 * t1 * J2 * inv, -0.46875 * J4 * inv * inv * n
    node1 = -t1 * cosi
    k = {
        "n": n, "a": a, "cosi": cosi, "sini": sini, "con41": con41, "x1": x1, "x7": 7 * c2 - 1, "eta": eta, "c1": c1, "c4": c4, "c5": c5, "full": perigee >= 220,
        "m_dot": n + 0.5 * t1 * root * con41 + 0.0625 * t2 * root * (13 - 78 * c2 + 137 * c2 * c2), "argp_dot": -0.5 * t1 * con42 + 0.0625 * t2 * (7 - 114 * c2 + 395 * c2 * c2) + t3 * (3 - 36 * c2 + 49 * c2 * c2),
        "node_dot": node1 + (0.5 * t2 * (4 - 19 * c2) + 2 * t3 * (3 - 7 * c2)) * cosi, "node_c": 3.5 * e2 * node1 * c1, "t2c": 1.5 * c1, "omg": b * c3 * np.cos(argp),
        "xm": np.where(e > 1e-4, -2 / 3 * coef * b / np.where(e > 1e-4, ee, 1.0), 0.0), "xl": -0.25 * (J3 / J2) * sini * (3 + 5 * cosi) / np.where(np.abs(1 + cosi) > 1.5e-12, 1 + cosi, 1.5e-12), "ay": -0.5 * (J3 / J2) * sini,
        "del_m0": (1 + eta * np.cos(m0)) ** 3, "sin_m0": np.sin(m0),
    }
    q = c1 * c1
    d2 = 4 * a * tsi * q
    d3 = (17 * a + s) * d2 * tsi * c1 / 3
    d4 = 0.5 * (d2 * tsi * c1 / 3) * a * tsi * (221 * a + 31 * s) * c1
    k |= {"d2": d2, "d3": d3, "d4": d4, "t3c": d2 + 2 * q, "t4c": 0.25 * (3 * d3 + c1 * (12 * d2 + 10 * q)), "t5c": 0.2 * (3 * d4 + 12 * c1 * d3 + 6 * d2 * d2 + 15 * q * (2 * d2 + q))}
    return k


def sgp4(elements: np.ndarray, minutes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(error codes, states) of rows of ELEMENTS at minutes after their epochs. States are km and km/s, NaN where the code
    isn't 0: 1 eccentricity out of range, 2 mean motion, 3 the same after sun and moon, 4 semi-latus rectum, 6 decayed, 99 no numbers."""
    with np.errstate(all="ignore"):
        rev, e = elements[:, 0], elements[:, 1]
        i, node, argp, m0 = np.radians(elements[:, 2:6]).T
        b, n0, t = elements[:, 6], rev * 2 * math.pi / 1440, minutes
        k = _drag(n0, e, i, argp, m0, b)
        mdf, argp_t, node_t, t2 = m0 + k["m_dot"] * t, argp + k["argp_dot"] * t, node + k["node_dot"] * t + k["node_c"] * t * t, t * t
        deep = 2 * math.pi / k["n"] >= 225
        k["full"] = k["full"] & ~deep
        shift = np.where(k["full"], k["omg"] * t + k["xm"] * ((1 + k["eta"] * np.cos(mdf)) ** 3 - k["del_m0"]), 0.0)
        m, w = mdf + shift, argp_t - shift
        full = lambda x: np.where(k["full"], x, 0.0)
        ta = 1 - k["c1"] * t - full(k["d2"] * t2 + k["d3"] * t2 * t + k["d4"] * t2 * t2)
        te = b * k["c4"] * t + full(b * k["c5"] * (np.sin(m) - k["sin_m0"]))
        tl = k["t2c"] * t2 + full(k["t3c"] * t2 * t + t2 * t2 * (k["t4c"] + t * k["t5c"]))
        nm, em, inc_t = k["n"].copy(), e.copy(), i.copy()
        if deep.any():
            d = np.nonzero(deep)[0]
            far = deepspace.prepare(k["n"][d], k["a"][d], e[d], i[d], node[d], argp[d], m0[d], (k["m_dot"][d], k["argp_dot"][d], k["node_dot"][d]), elements[d, 7])
            nm[d], em[d], inc_t[d], w[d], node_t[d], m[d] = deepspace.secular(far, t[d], e[d], i[d], w[d], node_t[d], m[d])
        a = (XKE / nm) ** (2 / 3) * ta * ta
        n = XKE / a**1.5
        em = em - te
        code = np.where((em >= 1) | (em < -0.001), 1, np.where(k["n"] <= 0, 2, 0))
        em = np.maximum(em, 1e-6)
        m = m + k["n"] * tl
        turn = 2 * math.pi
        whole = (m + w + node_t) % turn
        node_t, w = node_t % turn, w % turn
        m = (whole - w - node_t) % turn
        if deep.any():
            em[d], inc_t[d], w[d], node_t[d], m[d] = deepspace.periodic(far, t[d], em[d], inc_t[d], w[d], node_t[d], m[d])
            turned = inc_t < 0
            inc_t, node_t, w = np.abs(inc_t), np.where(turned, node_t + math.pi, node_t), np.where(turned, w - math.pi, w)
            code = np.where((code == 0) & ((em < 0) | (em > 1)), 3, code)
            c, s = np.cos(inc_t[d]), np.sin(inc_t[d])
            k["cosi"][d], k["sini"][d], k["con41"][d], k["x1"][d], k["x7"][d], k["ay"][d] = c, s, 3 * c * c - 1, 1 - c * c, 7 * c * c - 1, -0.5 * (J3 / J2) * s
            k["xl"][d] = -0.25 * (J3 / J2) * s * (3 + 5 * c) / np.where(np.abs(1 + c) > 1.5e-12, 1 + c, 1.5e-12)
        over = 1 / (a * (1 - em * em))
        ax, ay = em * np.cos(w), em * np.sin(w) + over * k["ay"]
        u = (m + w + over * k["xl"] * ax) % turn
        eo = u.copy()
        for _ in range(10):
            s, c = np.sin(eo), np.cos(eo)
            eo = eo + np.clip((u - ay * c + ax * s - eo) / (1 - c * ax - s * ay), -0.95, 0.95)
        s, c = np.sin(eo), np.cos(eo)
        ecos, esin, el2 = ax * c + ay * s, ax * s - ay * c, ax * ax + ay * ay
        pl = a * (1 - el2)
        code = np.where((code == 0) & (pl < 0), 4, code)
        r, beta = a * (1 - ecos), np.sqrt(1 - el2)
        r_dot, rv_dot, g = np.sqrt(a) * esin / r, np.sqrt(pl) / r, esin / (1 + beta)
        su, cu = a / r * (s - ay - ax * g), a / r * (c - ax + ay * g)
        sin2, cos2, angle = 2 * su * cu, 1 - 2 * su * su, np.arctan2(su, cu)
        j = 0.5 * J2 / pl
        jj = j / pl
        mr = r * (1 - 1.5 * jj * beta * k["con41"]) + 0.5 * j * k["x1"] * cos2
        angle, nd = angle - 0.25 * jj * k["x7"] * sin2, node_t + 1.5 * jj * k["cosi"] * sin2
        inc = inc_t + 1.5 * jj * k["cosi"] * k["sini"] * cos2
        mv, rv = r_dot - n * j * k["x1"] * sin2 / XKE, rv_dot + n * j * (k["x1"] * cos2 + 1.5 * k["con41"]) / XKE
        sa, ca, sn, cn, si, ci = np.sin(angle), np.cos(angle), np.sin(nd), np.cos(nd), np.sin(inc), np.cos(inc)
        up = np.stack([-sn * ci * sa + cn * ca, cn * ci * sa + sn * ca, si * sa], 1)
        on = np.stack([-sn * ci * ca - cn * sa, cn * ci * ca - sn * sa, si * ca], 1)
        out = np.concatenate([up * (mr * RE)[:, None], (up * mv[:, None] + on * rv[:, None]) * (RE * XKE / 60)], 1)
        code = np.where((code == 0) & (mr < 1), 6, code)
        bad = ~np.isfinite(elements[:, :7]).all(1) | ~np.isfinite(out).all(1)
        code = np.where((code == 0) & bad, 99, code)
    out[code != 0] = np.nan
    return code.astype(np.int32), out


def propagate(rows: DataFrame, minutes: str, out: str = "state") -> DataFrame:
    """``rows`` (with the columns ELEMENTS) plus ``out``: the state ``minutes`` after the epoch; on an error its numbers are
    null. Positions below 80 km or otherwise implausible have error 99, too."""
    ship(rows.sparkSession)
    kind = pa.struct([("error", pa.int32()), *[(c, pa.float64()) for c in ("x", "y", "z", "vx", "vy", "vz")]])

    @F.arrow_udf(STATE)
    def run(t: pa.Array, *columns: pa.Array) -> pa.Array:
        to = lambda a: a.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        code, states = sgp4(np.stack([to(c) for c in columns], 1), to(t))
        speed, height = np.linalg.norm(states[:, 3:], axis=1), np.linalg.norm(states[:, :3], axis=1) - orbit.EARTH_RADIUS_KM
        code = np.where((code == 0) & ~((height >= 80) & (height <= 400_000) & (speed >= 0.5) & (speed <= 12)), 99, code).astype(np.int32)
        arrays = [pa.array(np.where(code == 0, states[:, i], np.nan), from_pandas=True) for i in range(6)]
        return pa.StructArray.from_arrays([pa.array(code), *arrays], fields=list(kind))

    return rows.withColumn(out, run(F.col(minutes).cast("double"), *[F.col(c).cast("double") for c in ELEMENTS]))


def at_epochs(sets: DataFrame, epochs: DataFrame, line1: str = "line1", line2: str = "line2") -> DataFrame:
    """Every valid element set at every epoch of a short list (``epochs.epoch``): norad_id, epoch, state."""
    f = tle.fields(line1, line2)
    start = tle.epoch(f["epoch_year"], f["epoch_day"])
    rows = sets.where(F.size(tle.errors(line1, line2)) == 0).select("*", *[f[c].alias(c) for c in ["norad_id", *ELEMENTS]], start.alias("set_epoch"))
    grid = rows.join(F.broadcast(epochs)).withColumn("_m", (micros(F.col("epoch")) - micros(F.col("set_epoch"))) / 60e6)
    return propagate(grid, "_m").drop("_m")


def _decay(axis: np.ndarray, e: np.ndarray, b: np.ndarray, f107: np.ndarray) -> np.ndarray:
    """The same rate as ``orbit.decay_km_day``, for arrays."""
    h = axis - orbit.EARTH_RADIUS_KM
    rho = np.full(len(h), 3.5e-15)
    for low, high, scale, base in orbit.ATMOSPHERE:
        band = (h >= low) & (h < high)
        rho[band] = base * np.exp(-(h[band] - (low + high) / 2) / scale) * np.maximum(0.5, 1 + 0.012 * (f107[band] - 150))
    rho[h <= 0] = 1.225
    speed = np.sqrt(orbit.MU / axis**3) * axis * 1000
    area = np.where(np.abs(b) > 1e-10, 2 * b * (orbit.EARTH_RADIUS_KM * 1000) / 2.461e-5, 2.2e-3)
    return -rho * area * speed * speed * (1 + 1.5 * e * e) / 1000 * 86400


def reentry_days(df: DataFrame, axis: Column, e: Column, bstar: Column, f107: Column, out: str = "days", most: int = 365 * 50) -> DataFrame:
    """``df`` plus the days until the altitude is 80 km, in steps of a day; null where the orbit doesn't decay, stays up
    beyond ``most`` days, or has a perigee over 600 km. All objects of a batch step together."""
    ship(df.sparkSession)

    @F.arrow_udf("int")
    def run(a: pa.Array, ecc: pa.Array, b: pa.Array, f: pa.Array) -> pa.Array:
        x, ev, bv, fv = (c.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).copy() for c in (a, ecc, b, f))
        days = np.full(len(x), -1, np.int64)
        live = np.nonzero(np.isfinite(x + ev + bv + fv) & (x * (1 - ev) - orbit.EARTH_RADIUS_KM <= 600))[0]
        for day in range(most):
            if not len(live):
                break
            down = x[live] - orbit.EARTH_RADIUS_KM <= 80
            days[live[down]] = day
            live = live[~down]
            step = _decay(x[live], ev[live], bv[live], fv[live])
            falling = step < 0
            live, step = live[falling], step[falling]
            x[live] += step
        return pa.array(days, pa.int32(), mask=days < 0)

    return df.withColumn(out, run(axis.cast("double"), e.cast("double"), bstar.cast("double"), f107.cast("double")))


def alert_level(days: Column) -> Column:
    return F.when(days < 1 / 24, "IMMINENT").when(days < 0.25, "CRITICAL").when(days < 1, "URGENT").when(days < 3, "WARNING").when(days < 7, "WATCH")


def reentry_alert(days: Column, perigee: Column) -> dict[str, Column]:
    """Level, uncertainty in hours, survival and footprint of a predicted re-entry."""
    return {
        "alert": alert_level(days), "uncertainty_hours": days * 24 * F.when(perigee > 100, 0.2).otherwise(0.4), "survival": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (perigee - 100) / 200 * 0.3)),
        "footprint_km": F.least(F.lit(40_000.0), days * 2400.0),
    }
