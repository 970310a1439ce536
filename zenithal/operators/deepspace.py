"""The deep-space part of the published orbit model (periods of 225 minutes or more): attraction of sun and moon, and resonance
with the turning earth. Everything is numpy over rows at once; angles are radians, times minutes, motions radians a minute."""

from __future__ import annotations

import math

import numpy as np

TURN = 2 * math.pi
#: Fixed values of the model: eccentricity, mean motion and strength of sun and moon.
SUN = {"ecc": 0.01675, "motion": 1.19459e-5, "strength": 2.9864797e-6}
MOON = {"ecc": 0.05490, "motion": 1.5835218e-4, "strength": 4.7968065e-7}
#: The turn of the earth, and the step of the integration.
EARTH_MOTION, STEP = 4.37526908801129966e-3, 720.0
#: Phases of the 24-hour and of the 12-hour resonance, coefficients of the 24-hour one.
DAY_PHASES, HALF_PHASES = (0.13130908, 2.8843198, 0.37448087), {22: 5.7686396, 32: 0.95240898, 44: 1.8014998, 52: 1.0508330, 54: 4.4108898}
Q22, Q31, Q33 = 1.7891679e-6, 2.1460748e-6, 2.2123015e-7
#: Coefficients of the 12-hour resonance.
ROOT = {22: 1.7891679e-6, 32: 3.7393792e-7, 44: 7.3636953e-9, 52: 1.1428639e-7, 54: 2.1765803e-9}
#: Its polynomials in the eccentricity, ascending, below and above a limit.
G = {
    "211": (0.65, (3.616, -13.2470, 16.2900, 0.0), (-72.099, 331.819, -508.738, 266.724)), "310": (0.65, (-19.302, 117.3900, -228.4190, 156.5910), (-346.844, 1582.851, -2415.925, 1246.113)),
    "322": (0.65, (-18.9068, 109.7927, -214.6334, 146.5816), (-342.585, 1554.908, -2366.899, 1215.972)), "410": (0.65, (-41.122, 242.6940, -471.0940, 313.9530), (-1052.797, 4758.686, -7193.992, 3651.957)),
    "422": (0.65, (-146.407, 841.8800, -1629.014, 1083.4350), (-3581.690, 16178.110, -24462.770, 12422.520)), "520": (0.65, (-532.114, 3017.977, -5740.032, 3708.2760), (1464.74, -4664.75, 3763.64, 0.0)),
    "533": (0.7, (-919.22770, 4988.6100, -9064.7700, 5542.21), (-37995.780, 161616.52, -229838.20, 109377.94)), "521": (0.7, (-822.71072, 4568.6173, -8491.4146, 5337.524), (-51752.104, 218913.95, -309468.16, 146349.42)),
    "532": (0.7, (-853.66600, 4690.2500, -8624.7700, 5341.4), (-40023.880, 170470.89, -242699.48, 115605.82)),
}
G520_HIGH = (0.715, (-5149.66, 29936.92, -54087.36, 31324.56))


def sidereal(days: np.ndarray) -> np.ndarray:
    """Sidereal time at days since 1950 January 0."""
    c = (days + 2433281.5 - 2451545.0) / 36525
    return np.radians((-6.2e-6 * c**3 + 0.093104 * c * c + (876600 * 3600 + 8640184.812866) * c + 67310.54841) / 240) % TURN


def _body(g, i, h, body: dict, inc, argp, e, n) -> dict:
    """Terms of one body whose orbit has perigee ``g``, inclination ``i`` and node distance ``h``, each as (cosine, sine)."""
    (cg, sg), (ci, si), (ch, sh) = g, i, h
    cosi, sini, cw, sw = np.cos(inc), np.sin(inc), np.cos(argp), np.sin(argp)
    e2 = e * e
    b2 = 1 - e2
    a1, a3, a7, a8 = cg * ch + sg * ci * sh, -sg * ch + cg * ci * sh, -cg * sh + sg * ci * ch, sg * si
    a9, a10 = sg * sh + cg * ci * ch, cg * si
    a2, a4, a5, a6 = cosi * a7 + sini * a8, cosi * a9 + sini * a10, -sini * a7 + cosi * a8, -sini * a9 + cosi * a10
    x1, x2, x3, x4 = a1 * cw + a2 * sw, a3 * cw + a4 * sw, -a1 * sw + a2 * cw, -a3 * sw + a4 * cw
    x5, x6, x7, x8 = a5 * sw, a6 * sw, a5 * cw, a6 * cw
    z31, z32, z33 = 12 * x1 * x1 - 3 * x3 * x3, 24 * x1 * x2 - 6 * x3 * x4, 12 * x2 * x2 - 3 * x4 * x4
    z1, z2, z3 = 3 * (a1 * a1 + a2 * a2) + z31 * e2, 6 * (a1 * a3 + a2 * a4) + z32 * e2, 3 * (a3 * a3 + a4 * a4) + z33 * e2
    z11, z13 = -6 * a1 * a5 + e2 * (-24 * x1 * x7 - 6 * x3 * x5), -6 * a3 * a6 + e2 * (-24 * x2 * x8 - 6 * x4 * x6)
    z12 = -6 * (a1 * a6 + a3 * a5) + e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5))
    z21, z23 = 6 * a2 * a5 + e2 * (24 * x1 * x5 - 6 * x3 * x7), 6 * a4 * a6 + e2 * (24 * x2 * x6 - 6 * x4 * x8)
    z22 = 6 * (a4 * a5 + a2 * a6) + e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8))
    z1, z2, z3 = 2 * z1 + b2 * z31, 2 * z2 + b2 * z32, 2 * z3 + b2 * z33
    s3 = body["strength"] / n
    s2, s4 = -0.5 * s3 / np.sqrt(b2), s3 * np.sqrt(b2)
    s1 = -15 * e * s4
    ecc, motion, flat = body["ecc"], body["motion"], (inc < 5.2359877e-2) | (inc > math.pi - 5.2359877e-2)
    turn = np.where(flat, 0.0, -motion * s2 * (z21 + z23)) / np.where(sini == 0, 1.0, sini)
    return {
        # Of long-period terms: factors of f2, f3 and the sine.
        "e": (2 * s1 * (x2 * x3 + x1 * x4), 2 * s1 * (x2 * x4 - x1 * x3), 0.0), "i": (2 * s2 * z12, 2 * s2 * (z13 - z11), 0.0), "l": (-2 * s3 * z2, -2 * s3 * (z3 - z1), -2 * s3 * (-21 - 9 * e2) * ecc),
        "g": (2 * s4 * z32, 2 * s4 * (z33 - z31), -18 * s4 * ecc), "h": (-2 * s2 * z22, -2 * s2 * (z23 - z21), 0.0),
        # Rates.
        "de": s1 * motion * (x1 * x3 + x2 * x4), "di": s2 * motion * (z11 + z13), "dm": -motion * s3 * (z1 + z3 - 14 - 6 * e2), "dw": s4 * motion * (z31 + z33 - 6) - cosi * turn, "dn": turn,
    }


def prepare(n, a, e, inc, node, argp, m0, rates: tuple, days) -> dict:
    """What does not depend on time; ``rates``: of anomaly, perigee and node by the flattening; ``days`` since 1950 January 0."""
    day = days + 18261.5
    moon_node = (4.5236020 - 9.2422029e-4 * day) % TURN
    s, c = np.sin(moon_node), np.cos(moon_node)
    ci = 0.91375164 - 0.03568096 * c
    si = np.sqrt(1 - ci * ci)
    sh = 0.089683511 * s / si
    ch = np.sqrt(1 - sh * sh)
    gam = 5.8351514 + 0.0019443680 * day
    g = gam + np.arctan2(0.39785416 * s / si, ch * c + 0.91744867 * sh * s) - moon_node
    cn, sn = np.cos(node), np.sin(node)
    sun = _body((0.1945905, -0.98088458), (0.91744867, 0.39785416), (cn, sn), SUN, inc, argp, e, n)
    moon = _body((np.cos(g), np.sin(g)), (ci, si), (ch * cn + sh * sn, sn * ch - cn * sh), MOON, inc, argp, e, n)
    k = {x: sun[x] + moon[x] for x in ("de", "di", "dm", "dw", "dn")} | {"sun": sun, "moon": moon, "n0": n, "theta0": sidereal(days)}
    k |= {"moon_at": (4.7199672 + 0.22997150 * day - gam) % TURN, "sun_at": (6.2565837 + 0.017201977 * day) % TURN, "argp0": argp, "argp_dot": rates[1]}
    cosi, sini, e2 = np.cos(inc), np.sin(inc), e * e
    k["day"], k["half"] = (n > 0.0034906585) & (n < 0.0052359877), (n >= 8.26e-3) & (n <= 9.24e-3) & (e >= 0.5)
    # 24 hours
    step = 3 * n * n / a**2
    k["d1"] = step * (0.9375 * sini**2 * (1 + 3 * cosi) - 0.75 * (1 + cosi)) * (1 + 2 * e2) * Q31 / a
    k["d2"], k["d3"] = 2 * step * 0.75 * (1 + cosi) ** 2 * (1 + e2 * (-2.5 + 0.8125 * e2)) * Q22, 3 * step * 1.875 * (1 + cosi) ** 3 * (1 + e2 * (-6 + 6.60937 * e2)) * Q33 / a
    # 12 hours
    poly = lambda p: p[0] + p[1] * e + p[2] * e2 + p[3] * e2 * e
    gs = {name: np.where(e <= limit if limit == 0.65 else e < limit, poly(low), poly(high)) for name, (limit, low, high) in G.items()} | {"201": -0.306 - (e - 0.64) * 0.440}
    gs["520"] = np.where(e > G520_HIGH[0], poly(G520_HIGH[1]), gs["520"])
    c2, s2 = cosi * cosi, sini * sini
    f220 = 0.75 * (1 + 2 * cosi + c2)
    f522 = 9.84375 * sini * (s2 * (1 - 2 * cosi - 5 * c2) + 0.33333333 * (-2 + 4 * cosi + 6 * c2))
    f523 = sini * (4.92187512 * s2 * (-2 - 4 * cosi + 10 * c2) + 6.56250012 * (1 + 2 * cosi - 3 * c2))
    f542, f543 = 29.53125 * sini * (2 - 8 * cosi + c2 * (-12 + 8 * cosi + 10 * c2)), 29.53125 * sini * (-2 - 8 * cosi + c2 * (12 + 8 * cosi - 10 * c2))
    # (strength, perigees, longitudes, phase)
    k["terms"] = [
        (step * ROOT[22] * f220 * gs["201"], 2, 1, 22), (step * ROOT[22] * 1.5 * s2 * gs["211"], 0, 1, 22),
        (step / a * ROOT[32] * 1.875 * sini * (1 - 2 * cosi - 3 * c2) * gs["310"], 1, 1, 32), (step / a * ROOT[32] * -1.875 * sini * (1 + 2 * cosi - 3 * c2) * gs["322"], -1, 1, 32),
        (2 * step / a**2 * ROOT[44] * 35 * s2 * f220 * gs["410"], 2, 2, 44), (2 * step / a**2 * ROOT[44] * 39.3750 * s2 * s2 * gs["422"], 0, 2, 44),
        (step / a**3 * ROOT[52] * f522 * gs["520"], 1, 1, 52), (step / a**3 * ROOT[52] * f523 * gs["532"], -1, 1, 52),
        (2 * step / a**3 * ROOT[54] * f542 * gs["521"], 1, 2, 54), (2 * step / a**3 * ROOT[54] * f543 * gs["533"], -1, 2, 54),
    ]
    k["x0"] = np.where(k["half"], m0 + 2 * node - 2 * k["theta0"], m0 + node + argp - k["theta0"]) % TURN
    k["x_rate"] = np.where(k["half"], rates[0] + k["dm"] + 2 * (rates[2] + k["dn"] - EARTH_MOTION) - n, rates[0] + rates[1] + rates[2] - EARTH_MOTION + k["dm"] + k["dw"] + k["dn"] - n)
    return k


def _pull(k: dict, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The change of the mean motion at longitude ``x`` and time ``at``, and its derivative by the longitude."""
    p = DAY_PHASES
    one = k["d1"] * np.sin(x - p[0]) + k["d2"] * np.sin(2 * (x - p[1])) + k["d3"] * np.sin(3 * (x - p[2]))
    slope = k["d1"] * np.cos(x - p[0]) + 2 * k["d2"] * np.cos(2 * (x - p[1])) + 3 * k["d3"] * np.cos(3 * (x - p[2]))
    w = k["argp0"] + k["argp_dot"] * at
    angles = [(d, li, oi * w + li * x - HALF_PHASES[g]) for d, oi, li, g in k["terms"]]
    half, half_slope = sum(d * np.sin(t) for d, _, t in angles), sum(li * d * np.cos(t) for d, li, t in angles)
    return np.where(k["half"], half, one), np.where(k["half"], half_slope, slope)


def secular(k: dict, t, e, inc, argp, node, m):
    """(n, e, inc, argp, node, m) at ``t`` with the slow changes; resonant motions are integrated step by step."""
    e, inc, argp, node, m = e + k["de"] * t, inc + k["di"] * t, argp + k["dw"] * t, node + k["dn"] * t, m + k["dm"] * t
    resonant = k["day"] | k["half"]
    x, n, at = k["x0"].copy(), k["n0"].copy(), np.zeros_like(t)
    step = np.where(t >= 0, STEP, -STEP)
    while (go := resonant & (np.abs(t - at) >= STEP)).any():
        change, slope = _pull(k, x, at)
        rate = n + k["x_rate"]
        x, n, at = np.where(go, x + rate * step + change * STEP * STEP / 2, x), np.where(go, n + change * step + slope * rate * STEP * STEP / 2, n), np.where(go, at + step, at)
    change, slope = _pull(k, x, at)
    rate, left = n + k["x_rate"], t - at
    x, nt = x + rate * left + change * left * left / 2, n + change * left + slope * rate * left * left / 2
    theta = (k["theta0"] + t * EARTH_MOTION) % TURN
    m = np.where(k["half"], x - 2 * node + 2 * theta, np.where(k["day"], x - node - argp + theta, m))
    return np.where(resonant, nt, k["n0"]), e, inc, argp, node, m


def periodic(k: dict, t, e, inc, argp, node, m):
    """(e, inc, argp, node, m) with the periodic changes by sun and moon."""
    total = dict.fromkeys("eilgh", 0.0)
    for name, body, start in (("sun", SUN, k["sun_at"]), ("moon", MOON, k["moon_at"])):
        z = start + body["motion"] * t
        f = z + 2 * body["ecc"] * np.sin(z)
        f2, f3, f1 = 0.5 * np.sin(f) ** 2 - 0.25, -0.5 * np.sin(f) * np.cos(f), np.sin(f)
        for x in total:
            c = k[name][x]
            total[x] = total[x] + c[0] * f2 + c[1] * f3 + c[2] * f1
    inc, e = inc + total["i"], e + total["e"]
    s, c = np.sin(inc), np.cos(inc)
    steep = inc >= 0.2
    h = total["h"] / np.where(steep, s, 1.0)
    # Flat orbits: by the components of the pole, as the node is ill defined.
    sn, cn = np.sin(node), np.cos(node)
    alf, bet = s * sn + total["h"] * cn + total["i"] * c * sn, s * cn - total["h"] * sn + total["i"] * c * cn
    old = node % TURN
    longitude = m + argp + c * old + total["l"] + total["g"] - total["i"] * old * s
    new = np.arctan2(alf, bet)
    new = np.where(np.abs(old - new) > math.pi, np.where(new < old, new + TURN, new - TURN), new)
    m = m + total["l"]
    return e, inc, np.where(steep, argp + total["g"] - c * h, longitude - m - c * new), np.where(steep, node + h, new), m
