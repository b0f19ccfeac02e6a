"""Domain scalars: families, error models, severities, labels, ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class families; every other class is "other".
FAMILIES = {"vessel": "vessel", "aircraft": "aircraft", "helicopter": "aircraft", "vehicle": "vehicle", "large-vehicle": "vehicle", "storage-tank": "tank"}
# Fixed values by family: probability of staying put, top speed (m/s), persistence (days),
# days until a track is lost, spread of lengths (m).
STAY = {"vessel": 0.4, "aircraft": 0.7, "vehicle": 0.4, "tank": 0.99, "other": 0.95}
TOP_SPEED = {"vessel": 18.0, "aircraft": 300.0, "vehicle": 40.0, "tank": 0.0, "other": 0.0}
PERSISTENCE = {"vessel": 5.0, "aircraft": 20.0, "vehicle": 1.0, "tank": 3650.0, "other": 365.0}
LOST_AFTER = {"vessel": 30.0, "aircraft": 90.0, "vehicle": 10.0, "tank": 3650.0, "other": 730.0}
LENGTH_SPREAD = {"vessel": 400.0, "aircraft": 80.0, "vehicle": 25.0, "tank": 120.0, "other": 200.0}
# Ground sampling distance by source, 1 m otherwise.
GSD = {"sentinel-2": 10.0, "sentinel-1": 10.0, "landsat": 30.0}
# Knots per m/s, as observations and as events state them.
KNOTS = 1.943844
KNOTS_EVENT = 1.944


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def rounded(value: Column, digits: int) -> Column:
    """To so many digits, halves away from zero, for columns of very many rows: ``round`` takes every double through a decimal text.

    The scaled number must fit a long.
    """
    scale = float(10**digits)
    near = lambda x: F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(value < 0, -near(-value)).otherwise(near(value))


def family(cls: Column) -> Column:
    return _lookup(FAMILIES, cls, "other")


def stay(of: Column) -> Column:
    return _lookup(STAY, of, STAY["other"])


def top_speed(of: Column) -> Column:
    return _lookup(TOP_SPEED, of, TOP_SPEED["other"])


def length_spread(of: Column) -> Column:
    return _lookup(LENGTH_SPREAD, of, LENGTH_SPREAD["other"])


def persistence_days(of: Column) -> Column:
    return _lookup(PERSISTENCE, of, PERSISTENCE["other"])


def gsd_of(gsd: Column, source: Column) -> Column:
    """Stated ground sampling distance unless null or zero, else the source's."""
    return F.when(F.coalesce(gsd, F.lit(0.0)) != 0, gsd).otherwise(_lookup(GSD, source, 1.0))


def position_sigma(gsd: Column, length: Column) -> Column:
    return F.greatest(gsd * F.lit(1.5), F.lit(2.0)) + F.lit(0.05) * F.coalesce(length, F.lit(0.0))


def length_sigma(source: Column, gsd: Column, length: Column) -> Column:
    return F.when(source == "sentinel-1", F.greatest(F.lit(40.0), F.lit(0.25) * length)).otherwise(F.greatest(gsd * 2, F.lit(0.1) * length, F.lit(1.0)))


def gauss1(d: Column, sigma: Column) -> Column:
    return F.exp(-(d * d) / (sigma * sigma * 2)) / (sigma * F.lit(math.sqrt(2 * math.pi)))


def gauss2(d: Column, sigma: Column) -> Column:
    return F.exp(-(d * d) / (sigma * sigma * 2)) / (sigma * sigma * F.lit(2 * math.pi))


def beam(length: Column, width: Column) -> Column:
    """Stated width if it is less than the length, else a sixth of the length, 60 m being the usual one."""
    known = F.coalesce(length, F.lit(60.0))
    return F.when(width.isNotNull() & (width < known), width).otherwise(known / F.lit(6.0))


def object_severity(cls: Column, length: Column) -> Column:
    size = F.coalesce(length, F.lit(0.0))
    vessel = F.when(size >= 250, 0.85).when(size >= 150, 0.6).when(size >= 80, 0.45).otherwise(0.25)
    return F.when(cls == "vessel", vessel).when(cls.isin("aircraft", "helicopter"), 0.6).otherwise(0.2)


def size_word(length: Column) -> Column:
    return F.when(length.isNull() | (length == 0), "").otherwise(F.format_string("%d m ", F.bround(length, 0).cast("long")))


def length_bin(length: Column) -> Column:
    return (
        F.when(length.isNull(), "unknown")
        .when(length < 50, "<50")
        .when(length < 100, "50-100")
        .when(length < 200, "100-200")
        .when(length < 300, "200-300")
        .otherwise(">=300")
    )


def size_class(length: Column) -> Column:
    return (
        F.when(length >= 250, "very large (>=250 m)").when(length >= 100, "large (100-250 m)").when(length >= 40, "medium (40-100 m)").otherwise("small (<40 m)")
    )


def gsd_text(gsd: Column) -> Column:
    return F.when(gsd < 1, F.format_string("%d cm", F.round(gsd * 100, 0).cast("long"))).otherwise(F.format_string("%d m", F.round(gsd, 0).cast("long")))


def record_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def observation_key(scene: Column, detector: Column, cls: Column, lat: Column, lon: Column) -> Column:
    return record_key(scene, detector, cls, F.format_string("%.6f", lat), F.format_string("%.6f", lon))


def track_key(first_obs: Column) -> Column:
    return F.concat(F.lit("T"), F.substring(F.sha1(first_obs.cast("string").cast("binary")), 1, 11))


def decibel(v: Column, factor: int = 10) -> Column:
    return F.when(v > 0, F.log10(F.when(v > 0, v)) * F.lit(float(factor)))


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def dequantised(v: Column) -> Column:
    """Signed square of v / 127.5; -128 is no data."""
    x = v.cast("double") / F.lit(127.5)
    return F.when(v != -128, F.signum(v.cast("double")) * x * x)


def parsed_time(text: Column) -> Column:
    """Tolerant ISO time in UTC: blank or T between date and time, trailing Z, no zone is UTC; null if bad."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), " ", "T"), "[zZ]$", "")
    return F.coalesce(F.try_to_timestamp(clean, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(clean))


def period_key(time: Column, period: str) -> Column:
    """day, week (ISO year and week), month, quarter or year of a time, as text."""
    forms = {
        "day": F.date_format(time, "yyyy-MM-dd"),
        "week": F.concat(F.date_part(F.lit("YEAROFWEEK"), time).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(time).cast("string"), 2, "0")),
        "month": F.date_format(time, "yyyy-MM"),
        "quarter": F.concat(F.year(time).cast("string"), F.lit("-Q"), F.quarter(time).cast("string")),
        "year": F.date_format(time, "yyyy"),
    }
    if period not in forms:
        raise ValueError(f"unknown period {period}: one of {', '.join(forms)}")
    return forms[period]


def tiff_time(text: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` in UTC; null if it is anything else."""
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss"))


def since(text: Column, now: Column, default_days: int = 7) -> Column:
    """Start of a period: ``7d``, ``48h`` or ``2w`` before ``now``, a date or time, and without text ``default_days`` before."""
    clean = F.lower(F.trim(text))
    n = F.try_to_number(F.regexp_extract(clean, "^([0-9]+)[dhw]$", 1), F.lit("999999")).cast("int")
    unit = F.substring(clean, -1, 1)
    hours = n * F.when(unit == "h", 1).when(unit == "d", 24).otherwise(24 * 7)
    back = lambda h: F.timestamp_micros(F.unix_micros(now) - h.cast("long") * 3_600_000_000)
    return F.when(text.isNull() | (F.trim(text) == ""), back(F.lit(24 * default_days))).when(n.isNotNull(), back(hours)).otherwise(parsed_time(text))


def date_window(start: Column, end: Column, now: Column, days_back: float = 30) -> Column:
    """Struct (since, until) of a window of dates, the end day included; null where it would be empty."""
    until = F.coalesce(parsed_time(F.concat(end, F.lit("T23:59:59Z"))), now)
    begin = F.coalesce(parsed_time(F.concat(start, F.lit("T00:00:00Z"))), F.timestamp_micros(F.unix_micros(until) - F.lit(int(days_back * 86_400_000_000))))
    return F.when(begin < until, F.struct(begin.alias("since"), until.alias("until")))


def family_table(spark) -> DataFrame:
    """The constants by family as a table."""
    names = sorted(STAY)
    rows = [(f, STAY[f], TOP_SPEED[f], PERSISTENCE[f], LOST_AFTER[f], LENGTH_SPREAD[f]) for f in names]
    return spark.createDataFrame(rows, "family string, stay double, top_speed double, persistence_days double, lost_after_days double, length_spread double")


def knots(speed_ms: Column) -> Column:
    return speed_ms * F.lit(KNOTS)


def pass_scales(gsd: Column, fine: float = 0.3, limit: float = 0.7, coarse: float = 0.75) -> Column:
    """Scales at which objects are looked for: at high resolution a fine one for vehicles and a coarse one, else the image's own."""
    return F.when(gsd <= limit, F.array(F.lit(fine), F.greatest(F.lit(coarse), gsd))).otherwise(F.array(gsd))
