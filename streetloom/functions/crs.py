"""Longitude and latitude to UTM and back as Column expressions (transverse Mercator series on WGS 84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and UTM.
A, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]

_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def estimate_utm(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> int:
    """EPSG code of the UTM zone at the centre of a box."""
    zone = min(60, math.floor(((min_lon + max_lon) / 2 + 180) / 6) + 1)
    return (32600 if (min_lat + max_lat) / 2 >= 0 else 32700) + zone


def _zone(epsg: int) -> tuple[float, float]:
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"not a UTM zone: {epsg}")
    return math.radians(-183 + 6 * (epsg % 100)), FALSE_NORTH if epsg >= 32700 else 0.0


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    meridian, north = _zone(epsg)
    phi, lam = F.radians(lat), F.radians(lon) - F.lit(meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + SCALE * _RECTIFYING * x, north + SCALE * _RECTIFYING * y


def from_utm(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    meridian, north = _zone(epsg)
    xi, eta = (y - north) / (SCALE * _RECTIFYING), (x - FALSE_EAST) / (SCALE * _RECTIFYING)
    u, w = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        w = w - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal, lam = F.asin(F.sin(u) / F.cosh(w)), F.atan2(F.sinh(w), F.cos(u))
    phi = conformal
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * conformal)
    return F.degrees(lam + F.lit(meridian)), F.degrees(phi)


def line_to_utm(line: Column, epsg: int) -> Column:
    """A line of {lat, lon} as a line of {x, y}."""

    def one(p: Column) -> Column:
        x, y = to_utm(p["lon"], p["lat"], epsg)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(line, one)
