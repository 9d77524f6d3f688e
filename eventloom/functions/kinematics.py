"""Kinematics as built-in column expressions. A value that isn't finite is null."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), None).otherwise(x)


def delta_phi(a: Column, b: Column) -> Column:
    """a - b wrapped to [-pi, pi)."""
    turn = F.lit(2 * math.pi)
    d = (a - b + F.lit(math.pi)) % turn
    return F.when(d < 0, d + turn).otherwise(d) - F.lit(math.pi)


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    return F.hypot(eta1 - eta2, delta_phi(phi1, phi2))


def vector(pt: Column, eta: Column, phi: Column, m: Column) -> tuple[Column, ...]:
    px, py, pz = pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta)
    return px, py, pz, F.sqrt(px * px + py * py + pz * pz + m * m)


def transverse(pt: Column, phi: Column) -> tuple[Column, ...]:
    """A massless vector without a longitudinal part, as missing momentum is."""
    return pt * F.cos(phi), pt * F.sin(phi), F.when(pt.isNotNull() & phi.isNotNull(), F.lit(0.0)), F.when(phi.isNotNull(), pt)


def total(parts: list[tuple[Column, ...]]) -> tuple[Column, ...]:
    return tuple(reduce(lambda a, b: a + b, c) for c in zip(*parts, strict=True))


def of_vector(v: tuple[Column, ...], prop: str) -> Column:
    px, py, pz, e = v
    if prop == "m":
        return finite(F.sqrt(F.greatest(e * e - (px * px + py * py + pz * pz), F.lit(0.0))))
    v = {"pt": lambda: F.hypot(px, py), "phi": lambda: F.atan2(py, px), "eta": lambda: F.asinh(F.try_divide(pz, F.hypot(px, py))), "e": lambda: e}[prop]()
    return finite(F.when(e.isNotNull(), v))  # a particle without a mass has no vector
