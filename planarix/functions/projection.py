"""UTM zone 33 and Web Mercator tiles as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the zone's constants.
A, FLAT, K0, LON0, EAST = 6378137.0, 1 / 298.257223563, 0.9996, math.radians(15.0), 500000.0
_N = FLAT / (2 - FLAT)
_R = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Kruger series to the third order
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed, and written into the plan, once."""
    return F.transform(F.array(value), body)[0]


def lonlat_to_xy(lon: Column, lat: Column) -> Column:
    """struct(x, y): forward transverse Mercator of zone 33."""
    p, d = F.radians(lat), F.radians(lon) - LON0
    e = 2 * math.sqrt(_N) / (1 + _N)

    def series(k: Column) -> Column:
        xi, eta = k["xi"], k["eta"]
        x, y = eta, xi
        for j, a in enumerate(_ALPHA, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct((EAST + K0 * _R * x).alias("x"), (K0 * _R * y).alias("y"))

    def conformal(k: Column) -> Column:
        return F.struct(F.atan2(k["t"], F.cos(k["d"])).alias("xi"), F.atanh(F.sin(k["d"]) / F.sqrt(1 + k["t"] * k["t"])).alias("eta"))

    tan = _let(F.sin(p), lambda s: F.sinh(F.atanh(s) - e * F.atanh(e * s)))
    return _let(_let(F.struct(tan.alias("t"), d.alias("d")), conformal), series)


def xy_to_lonlat(x: Column, y: Column) -> Column:
    """struct(lon, lat): inverse of lonlat_to_xy."""

    def unstretch(k: Column) -> Column:
        xi, eta = k["xi"], k["eta"]
        u, v = xi, eta
        for j, b in enumerate(_BETA, 1):
            u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return F.struct(u.alias("u"), v.alias("v"))

    def sphere(k: Column) -> Column:
        return F.struct(F.asin(F.sin(k["u"]) / F.cosh(k["v"])).alias("chi"), F.degrees(F.atan2(F.sinh(k["v"]), F.cos(k["u"])) + LON0).alias("lon"))

    def geodetic(k: Column) -> Column:
        lat = k["chi"]
        for j, d in enumerate(_DELTA, 1):
            lat = lat + d * F.sin(2 * j * k["chi"])
        return F.struct(k["lon"].alias("lon"), F.degrees(lat).alias("lat"))

    start = F.struct((y / (K0 * _R)).alias("xi"), ((x - EAST) / (K0 * _R)).alias("eta"))
    return _let(_let(_let(start, unstretch), sphere), geodetic)


def lonlat_to_tile(lon: Column, lat: Column, z: int) -> Column:
    """struct(x, y): Web Mercator tile of a position."""
    n, s = float(1 << z), F.sin(F.radians(lat))
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit((1 << z) - 1), F.floor(v).cast("long")))
    return F.struct(clamp((lon + 180.0) / 360.0 * n).alias("x"), clamp((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n).alias("y"))


def tile_to_lonlat(tx: Column, ty: Column, z: int) -> Column:
    """struct(lon, lat): the upper left corner of a tile."""
    n = float(1 << z)
    return F.struct((tx / n * 360.0 - 180.0).alias("lon"), F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * ty / n)))).alias("lat"))


# Masks that spread the bits of a tile number.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def quadbin(tx: Column, ty: Column, z: int) -> Column:
    """64-bit quad cell id: header, mode, resolution and interleaved tile numbers, unused low bits set."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in _SPREAD:
            v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask))
        return v

    code = spread(tx).bitwiseOR(F.shiftleft(spread(ty), 1))
    head = 0x4000000000000000 | (1 << 59) | (z << 52) | ((1 << (52 - 2 * z)) - 1)
    return F.lit(head).bitwiseOR(F.shiftleft(code, 52 - 2 * z))
