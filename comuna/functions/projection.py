"""Transverse Mercator zones of the WGS84 ellipsoid as column expressions, by the usual series in the third flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid, and a zone's scale, false easting and false northing of the southern half.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the series to the fourth power, for the plane, back, and from the conformal latitude.
_FORTH = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _series(factors: tuple[float, ...], of, *args: Column) -> Column:
    return sum((F.lit(c) * of(*[F.lit(2.0 * j) * a for a in args]) for j, c in enumerate(factors, 1)), F.lit(0.0))


def to_degrees(easting: Column, northing: Column, zone: int, south: bool = True) -> tuple[Column, Column]:
    """Latitude and longitude of a point in metres of a zone (1 to 60); null where either is null."""
    x, y = (easting - EAST) / _RADIUS, (northing - (SOUTH if south else 0.0)) / _RADIUS
    u = y - _series(_BACK, lambda a, b: F.sin(a) * F.cosh(b), y, x)
    v = x - _series(_BACK, lambda a, b: F.cos(a) * F.sinh(b), y, x)
    conformal = F.asin(F.sin(u) / F.cosh(v))
    return F.degrees(conformal + _series(_LATITUDE, F.sin, conformal)), F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (6 * zone - 183)


def to_metres(lat: Column, lon: Column, zone: int, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing of a point in a zone (1 to 60); null where either is null."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    s, away = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    u, v = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    easting = EAST + _RADIUS * (v + _series(_FORTH, lambda a, b: F.cos(a) * F.sinh(b), u, v))
    northing = (SOUTH if south else 0.0) + _RADIUS * (u + _series(_FORTH, lambda a, b: F.sin(a) * F.cosh(b), u, v))
    return easting, northing
