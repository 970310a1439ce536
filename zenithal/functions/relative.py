"""Relative motion near a circular orbit (Clohessy-Wiltshire), in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zenithal.functions.orbit import EARTH_RADIUS_KM, MU

NAMES = ("x", "y", "z", "vx", "vy", "vz")
State = dict[str, Column]


def rate(altitude_km: Column) -> Column:
    """Mean motion of the chief in rad/s."""
    return F.sqrt(MU / F.pow(altitude_km + EARTH_RADIUS_KM, 3.0))


def transition(n: Column, t: Column) -> list[list[Column | float]]:
    """The 6 x 6 matrix that takes a state at 0 to one at ``t`` seconds."""
    a = n * t
    c, s = F.cos(a), F.sin(a)
    return [
        [4 - 3 * c, 0.0, 0.0, s / n, 2 * (1 - c) / n, 0.0],
        [6 * (s - a), 1.0, 0.0, -2 * (1 - c) / n, (4 * s - 3 * a) / n, 0.0],
        [0.0, 0.0, c, 0.0, 0.0, s / n],
        [3 * n * s, 0.0, 0.0, c, 2 * s, 0.0],
        [6 * n * (c - 1), 0.0, 0.0, -2 * s, 4 * c - 3, 0.0],
        [0.0, 0.0, -n * s, 0.0, 0.0, c],
    ]


def propagate(state: State, n: Column, t: Column) -> State:
    out = {}
    for name, row in zip(NAMES, transition(n, t), strict=True):
        terms = [k * state[m] for k, m in zip(row, NAMES, strict=True) if not (isinstance(k, float) and k == 0.0)]
        total = terms[0]
        for x in terms[1:]:
            total = total + x
        out[name] = total
    return out


def drift_ellipse(s: State, n: Column) -> dict[str, Column]:
    """Half axes and centre of the free motion about the chief."""
    radial, along = s["vx"] / n, 2 * s["vy"] / n
    return {
        "semi_axis_radial_km": F.sqrt(radial * radial + along * along), "semi_axis_along_track_km": 2 * F.sqrt(radial * radial + F.pow(along - s["x"], 2.0) / 4),
        "semi_axis_cross_track_km": F.sqrt(s["z"] * s["z"] + F.pow(s["vz"] / n, 2.0)), "ellipse_centre_y_km": s["y"] - 2 * radial,
    }


def drift_nulling(s: State, n: Column) -> Column:
    """The along-track impulse after which the deputy no longer drifts."""
    return -2.0 * n * s["x"] - s["vy"]


def rendezvous(s: State, n: Column, t_burn: Column, t_final: Column, target: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> dict[str, Column]:
    """Two impulses that bring the deputy to ``target`` at ``t_final`` and stop it there.

    The velocity wanted at the burn solves a 2 x 2 system in the plane and one equation across it; null where that has no
    solution (the transfer time is a multiple of the period)."""
    m = propagate(s, n, t_burn)
    phi = transition(n, t_final - t_burn)
    gap = [target[i] - sum((phi[i][j] * m[NAMES[j]] for j in range(1, 3)), phi[i][0] * m["x"]) for i in range(3)]
    det = phi[0][3] * phi[1][4] - phi[0][4] * phi[1][3]
    safe = lambda d: F.when(F.abs(d) > 1e-12, d)
    vx = (phi[1][4] * gap[0] - phi[0][4] * gap[1]) / safe(det)
    vy = (phi[0][3] * gap[1] - phi[1][3] * gap[0]) / safe(det)
    vz = gap[2] / safe(phi[2][5])
    end = propagate(dict(zip(NAMES, (m["x"], m["y"], m["z"], vx, vy, vz), strict=True)), n, t_final - t_burn)
    return {
        "dv1_x": vx - m["vx"], "dv1_y": vy - m["vy"], "dv1_z": vz - m["vz"],
        "dv2_x": -end["vx"], "dv2_y": -end["vy"], "dv2_z": -end["vz"], "x_final": end["x"], "y_final": end["y"], "z_final": end["z"],
    }
