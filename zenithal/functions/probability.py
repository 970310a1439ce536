"""Collision probability: the encounter plane, the short series and a quadrature, as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from zenithal.functions.frames import Vector, cross, dot, norm


def encounter_plane(v: Vector) -> tuple[Vector, Vector]:
    """Two unit vectors across the relative velocity."""
    speed = norm(v)
    u = [x / speed for x in v]
    steep = F.abs(u[2]) > 0.9
    first = cross(u, [F.lit(0.0), F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0)])
    size = norm(first)
    first = [x / size for x in first]
    return first, cross(u, first)


def encounter(r: Vector, v: Vector, variance: Vector) -> dict[str, Column]:
    """Miss and spread in the encounter plane for a combined diagonal covariance (km2): standard deviations along the main
    axes (larger first), and the squared miss in units of them."""
    a, b = encounter_plane(v)
    quad = lambda p, q: sum((p[i] * q[i] * variance[i] for i in range(1, 3)), p[0] * q[0] * variance[0])
    caa, cab, cbb = quad(a, a), quad(a, b), quad(b, b)
    ra, rb = dot(a, r), dot(b, r)
    half, gap = (caa + cbb) / 2, F.sqrt(F.pow((caa - cbb) / 2, 2.0) + cab * cab)
    high, low = F.greatest(half + gap, F.lit(1e-20)), F.greatest(half - gap, F.lit(1e-20))
    det = caa * cbb - cab * cab
    miss = (cbb * ra * ra - 2 * cab * ra * rb + caa * rb * rb) / det
    return {"sigma_x": F.sqrt(high), "sigma_y": F.sqrt(low), "u_sq": miss, "miss_km": norm(r), "speed_kms": norm(v)}


def series(u_sq: Column, sigma_x: Column, sigma_y: Column, hbr: Column, terms: int = 50) -> Column:
    """The short series with the mean of both deviations, kept within [0, 1]."""
    sigma = (sigma_x + sigma_y) / 2.0
    h = F.pow(hbr / sigma, 2.0) / 2.0
    first = h * F.exp(-0.5 * u_sq) / (2 * math.pi * sigma * sigma)
    zero = F.struct(first.alias("term"), first.alias("sum"))
    step = lambda acc, k: F.struct((acc["term"] * h / k).alias("term"), (acc["sum"] + acc["term"] * h / k).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms - 1)), zero, step)["sum"] * (2.0 * math.pi)
    return F.when(sigma < 1e-10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def quadrature(miss_x: Column, miss_y: Column, sigma_x: Column, sigma_y: Column, hbr: Column, radial: int = 6, angular: int = 16) -> Column:
    """The two-dimensional Gaussian integrated over the disk of radius ``hbr`` about the miss, by Gauss-Legendre nodes in
    the radius and even nodes in the angle."""
    nodes, weights = np.polynomial.legendre.leggauss(radial)
    total = F.lit(0.0)
    for x, w in zip(nodes.tolist(), weights.tolist(), strict=True):
        r = (x + 1) / 2
        for k in range(angular):
            t = 2 * math.pi * (k + 0.5) / angular
            a, b = (miss_x + hbr * (r * math.cos(t))) / sigma_x, (miss_y + hbr * (r * math.sin(t))) / sigma_y
            total = total + (w / 2 * r * 2 * math.pi / angular) * F.exp(-0.5 * (a * a + b * b))
    return F.least(F.lit(1.0), total * hbr * hbr / (2 * math.pi * sigma_x * sigma_y))
