"""Geometry and time as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per degree. Two latitude constants are in use and both are kept.
M_PER_LON = 111320.0
M_PER_LAT = 110574.0
M_PER_LAT_LOCAL = 110540.0
EARTH_KM = 6371.0
MERCATOR_LAT = 85.0511


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance at the mean latitude."""
    x = (lon2 - lon1) * F.lit(M_PER_LON) * F.cos(F.radians((lat1 + lat2) / F.lit(2.0)))
    y = (lat2 - lat1) * F.lit(M_PER_LAT)
    return F.sqrt(x * x + y * y)


def local_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return (lon - lon0) * F.lit(M_PER_LON) * F.cos(F.radians(lat0))


def local_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * F.lit(M_PER_LAT_LOCAL)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / F.lit(2.0))) * F.lit(M_PER_LON)
    y = (lat2 - lat1) * F.lit(M_PER_LAT)
    return F.pmod(F.degrees(F.atan2(x, y)) + F.lit(360.0), F.lit(360.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def axis_difference(a: Column, b: Column) -> Column:
    """Between two axes of 0 to 180 degrees, folded to 0 to 90; null if either is."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.when(a.isNotNull() & b.isNotNull(), F.least(d, F.lit(180.0) - d))


def inside(lat: Column, lon: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Point in box, edges included; a box without a west edge covers everything."""
    return w.isNull() | (lon.between(w, e) & lat.between(s, n))


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes (w, s, e, n) that share at least an edge point."""
    return ~((a[2] < b[0]) | (b[2] < a[0]) | (a[3] < b[1]) | (b[3] < a[1]))


def overlap_share(area: tuple[Column, ...], box: tuple[Column, ...]) -> Column:
    """Share of ``area`` inside ``box``; 1 for an empty area that they share, 0 without an overlap."""
    dx = F.least(area[2], box[2]) - F.greatest(area[0], box[0])
    dy = F.least(area[3], box[3]) - F.greatest(area[1], box[1])
    own = (area[2] - area[0]) * (area[3] - area[1])
    return F.when((dx <= 0) | (dy <= 0), F.lit(0.0)).when(own == 0, F.lit(1.0)).otherwise(dx * dy / own)


def size_km(w: Column, s: Column, e: Column, n: Column) -> tuple[Column, Column]:
    mid = F.radians((s + n) / F.lit(2.0))
    return (e - w) * F.lit(M_PER_LON / 1000) * F.cos(mid), (n - s) * F.lit(M_PER_LAT / 1000)


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def tile_of(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile of a point, clamped to the projection and to the tile range."""
    n = 2**zoom
    y = F.radians(F.greatest(F.least(lat, F.lit(MERCATOR_LAT)), F.lit(-MERCATOR_LAT)))
    col = F.floor((lon + 180) / F.lit(360.0) * n)
    row = F.floor((F.lit(1.0) - F.asinh(F.tan(y)) / F.lit(math.pi)) / 2 * n)
    clamp = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    return clamp(col), clamp(row)


def tile_box(col: Column, row: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    n = float(2**zoom)
    lon = lambda c: c / F.lit(n) * F.lit(360.0) - F.lit(180.0)
    lat = lambda r: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * r / F.lit(n)))))
    return lon(col), lat(row + 1), lon(col + 1), lat(row)


def cell(value: Column, width: float) -> Column:
    """Number of the grid cell of a coordinate."""
    return F.floor(value / F.lit(width))


def gmst_degrees(days: Column) -> Column:
    """Greenwich mean sidereal angle at days since J2000."""
    return F.pmod(F.lit(280.46061837) + F.lit(360.98564736629) * days, F.lit(360.0))


def sun_elevation(unix: Column, lat: Column, lon: Column) -> Column:
    """Approximate solar elevation in degrees (low-precision almanac series)."""
    d = (unix - F.lit(946728000.0)) / F.lit(86400.0)
    g = F.radians(F.pmod(F.lit(357.529) + F.lit(0.98560028) * d, F.lit(360.0)))
    q = F.lit(280.459) + F.lit(0.98564736) * d
    ecliptic = F.radians(q + F.lit(1.915) * F.sin(g) + F.lit(0.020) * F.sin(g * 2))
    tilt = F.radians(F.lit(23.439) - F.lit(0.00000036) * d)
    right = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    hour = F.radians(gmst_degrees(d) + lon) - right
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(hour)))


def parse_area(text: str, radius_km: float = 10.0) -> tuple[float, float, float, float] | None:
    """Box of ``lat,lon`` or ``w,s,e,n``; None for anything else, an error outside the globe."""
    parts = re.fullmatch(r"\s*(-?[\d.]+)\s*[, ]\s*(-?[\d.]+)(?:\s*[, ]\s*(-?[\d.]+)\s*[, ]\s*(-?[\d.]+))?\s*", text)
    if not parts:
        return None
    v = [float(x) for x in parts.groups() if x is not None]
    if len(v) == 2:
        lat, lon = v
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise ValueError(f"not on the globe: {text}")
        return box_around(lat, lon, radius_km)
    w, s, e, n = v
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError(f"not a box: {text}")
    return w, s, e, n


def box_around(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    dy = radius_km * 1000 / M_PER_LAT
    dx = radius_km * 1000 / (M_PER_LON * max(math.cos(math.radians(lat)), 0.01))
    return lon - dx, lat - dy, lon + dx, lat + dy


def box_of(lat: Column, lon: Column, radius_km: Column) -> tuple[Column, Column, Column, Column]:
    """``box_around`` as columns."""
    dy = radius_km * F.lit(1000.0) / F.lit(M_PER_LAT)
    dx = radius_km * F.lit(1000.0) / (F.lit(M_PER_LON) * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return lon - dx, lat - dy, lon + dx, lat + dy


def area_of(text: Column, radius_km: float = 10.0) -> Column:
    """Box struct (w, s, e, n) of the text ``lat,lon`` or ``w,s,e,n``; null for anything else and for what is not on the globe."""
    parts = F.transform(F.split(F.trim(text), "[, ]+"), lambda x: F.when(F.rlike(x, F.lit("^-?[0-9.]+$")), F.try_to_number(x, F.lit("S9999D999999")).cast("double")))
    v = lambda i: F.get(parts, F.lit(i))
    known = ~F.exists(parts, lambda x: x.isNull())
    point = known & (F.size(parts) == 2) & v(0).between(-90, 90) & v(1).between(-180, 180)
    box = known & (F.size(parts) == 4) & (v(0) >= -180) & (v(0) < v(2)) & (v(2) <= 180) & (v(1) >= -90) & (v(1) < v(3)) & (v(3) <= 90)
    named = lambda b: F.struct(*[c.alias(n) for c, n in zip(b, "wsen", strict=True)])
    return F.when(point, named(box_of(v(0), v(1), F.lit(float(radius_km))))).when(box, named((v(0), v(1), v(2), v(3))))


def too_large(w: Column, s: Column, e: Column, n: Column, max_km: float) -> Column:
    """Whether an area is more than twice ``max_km`` (and one more) across."""
    return F.greatest(*size_km(w, s, e, n)) > F.lit(2 * max_km + 1)


# Origin and extent of the tile grid, in metres of a UTM zone.
GRID_X0, GRID_Y0, GRID_EXTENT = -9_740_000.0, 10_240_000.0, 20_480_000.0


def quadkey_box(quadkey: Column) -> tuple[Column, Column, Column, Column]:
    """Box in UTM metres of a quadkey: of each digit the low bit goes to the column, the next to the row."""
    digits = F.transform(F.filter(F.split(quadkey, ""), lambda c: c != ""), lambda c: c.cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    step = lambda a, d: F.struct((a["x"] * 2 + d.bitwiseAND(1)).alias("x"), (a["y"] * 2 + F.shiftright(d, 1).bitwiseAND(1)).alias("y"))
    tile = F.aggregate(digits, zero, step)
    size = F.lit(GRID_EXTENT) / F.pow(F.lit(2.0), F.char_length(quadkey))
    x, y = F.lit(GRID_X0) + tile["x"] * size, F.lit(GRID_Y0) - tile["y"] * size
    return x, y - size, x + size, y
