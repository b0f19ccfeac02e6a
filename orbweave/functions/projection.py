"""The transverse Mercator projection and its UTM zones as column expressions.

Krüger's series in the third flattening to the fourth order: within a zone forward and back agree to
well under a millimetre. Everything stays inside generated code; nothing is looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid, and scale and false origins of a zone.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0

_n = FLATTENING / (2 - FLATTENING)
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Radius of the sphere of equal meridians, scaled.
_A = SCALE * RADIUS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
# The series' coefficients, to the plane, from it, and from conformal to geographic latitude.
FORWARD = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440, 61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280)
INVERSE = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280)
LATITUDE = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630)


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _meridian(epsg: Column) -> Column:
    return F.radians(((epsg % 100) * 6 - 183).cast("double"))


def _north(epsg: Column) -> Column:
    return F.when(epsg >= 32700, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))


def to_utm(lat: Column, lon: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of a point in the zone of an EPSG code (326zz north, 327zz south), also a little outside it."""
    sine, turn = F.sin(F.radians(lat)), F.radians(lon) - _meridian(epsg)
    t = F.sinh(F.atanh(sine) - F.atanh(sine * _ECC) * _ECC)
    x, y = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
    north = x + _sum([F.sin(x * (2 * j)) * F.cosh(y * (2 * j)) * a for j, a in enumerate(FORWARD, 1)])
    east = y + _sum([F.cos(x * (2 * j)) * F.sinh(y * (2 * j)) * a for j, a in enumerate(FORWARD, 1)])
    return east * _A + FALSE_EAST, north * _A + _north(epsg)


def from_utm(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a point of a zone."""
    x, y = (north - _north(epsg)) / _A, (east - FALSE_EAST) / _A
    u = x - _sum([F.sin(x * (2 * j)) * F.cosh(y * (2 * j)) * b for j, b in enumerate(INVERSE, 1)])
    v = y - _sum([F.cos(x * (2 * j)) * F.sinh(y * (2 * j)) * b for j, b in enumerate(INVERSE, 1)])
    conformal = F.atan2(F.sin(u), F.hypot(F.sinh(v), F.cos(u)))
    lat = conformal + _sum([F.sin(conformal * (2 * j)) * d for j, d in enumerate(LATITUDE, 1)])
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(v), F.cos(u)) + _meridian(epsg))


def _outline(w: Column, s: Column, e: Column, n: Column, between: int) -> Column:
    """Points along the sides of a box: its corners and ``between`` more on every side."""
    steps = F.sequence(F.lit(0), F.lit(between + 1))
    part = lambda a, b, k: a + (b - a) * (k.cast("double") / (between + 1))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    sides = [F.transform(steps, lambda k: at(part(w, e, k), s)), F.transform(steps, lambda k: at(part(w, e, k), n)), F.transform(steps, lambda k: at(w, part(s, n, k))), F.transform(steps, lambda k: at(e, part(s, n, k)))]
    return F.concat(*sides)


def box_to_utm(w: Column, s: Column, e: Column, n: Column, epsg: Column, between: int = 21) -> tuple[Column, Column, Column, Column]:
    """The box in metres around a box in degrees, whose sides bend: points along them are projected."""
    points = F.transform(_outline(w, s, e, n, between), lambda p: F.struct(*[c.alias(k) for k, c in zip("xy", to_utm(p["y"], p["x"], epsg), strict=True)]))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def box_from_utm(x0: Column, y0: Column, x1: Column, y1: Column, epsg: Column, between: int = 5) -> tuple[Column, Column, Column, Column]:
    """The box in degrees (w, s, e, n) around a box in metres."""
    points = F.transform(_outline(x0, y0, x1, y1, between), lambda p: F.struct(*[c.alias(k) for k, c in zip(("lat", "lon"), from_utm(p["x"], p["y"], epsg), strict=True)]))
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat)


def grid_for(w: Column, s: Column, e: Column, n: Column, epsg: Column, res: float, most_pixels: int) -> Column:
    """Grid over a box in its zone as a struct: origin ``x0``, ``y1``, ``res``, ``width``, ``height``; coarser where a side would exceed ``most_pixels``."""
    x0, y0, x1, y1 = box_to_utm(w, s, e, n, epsg)

    def laid(b: Column) -> Column:
        wide, high = b["x1"] - b["x0"], b["y1"] - b["y0"]
        fine = F.greatest(F.lit(float(res)), wide / most_pixels, high / most_pixels)
        cells = lambda side: F.greatest(F.lit(1).cast("long"), F.ceil(F.round(side / fine, 9)))
        return F.struct(b["x0"].alias("x0"), b["y1"].alias("y1"), fine.alias("res"), cells(wide).alias("width"), cells(high).alias("height"))

    # The box is bound once; without that every use would project its outline again.
    return F.get(F.transform(F.array(F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))), laid), F.lit(0))
