"""Overpasses from an ephemeris table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import geo
from orbweave.operators.windows import first_per_group, local_minima

# Swath widths and, for the radar, the range of its swath to the right, in km.
SWATH_KM = {"sentinel-2": 290.0, "landsat": 185.0}
RADAR_KM = (100.0, 500.0)
REACH_KM = 800.0
#: Seconds of the buckets of which only those with a moment within reach are sorted.
BUCKET_S = 600.0


def next_passes(ephemeris: DataFrame, lat: float, lon: float) -> DataFrame:
    """Closest approaches within reach, and whether each will likely give an image.

    ``ephemeris``: sat, family, t (seconds), lat, lon of the ground track and heading (degrees).
    """
    here = (F.lit(lat), F.lit(lon))
    rows = ephemeris.withColumn("distance_km", geo.haversine_km(F.col("lat"), F.col("lon"), *here))
    near = local_minima(rows, ["sat"], "t", "distance_km", REACH_KM, BUCKET_S)
    turn = F.pmod(geo.bearing(F.col("lat"), F.col("lon"), *here) - F.col("heading") + 360, F.lit(360.0))
    side = F.when(turn < 180, "right").otherwise("left")
    down = F.cos(F.radians("heading")) < 0
    sun = geo.sun_elevation(F.col("t"), *here)
    swath = F.element_at(F.create_map(*[F.lit(v) for kv in SWATH_KM.items() for v in kv]), F.col("family"))
    radar = (F.col("side") == "right") & F.col("distance_km").between(*RADAR_KM)
    optical = (F.col("distance_km") <= swath / 2) & down & (F.col("sun") > 10)
    return (
        near.withColumn("side", side)
        .withColumn("direction", F.when(down, "descending").otherwise("ascending"))
        .withColumn("sun", sun)
        .withColumn("likely", F.coalesce(F.when(F.col("family") == "sentinel-1", radar).otherwise(optical), F.lit(False)))
        .select("sat", "family", "t", F.round("distance_km", 1).alias("distance_km"), "side", "direction", F.round("sun", 1).alias("sun"), "likely")
    )


def next_looks(passes: DataFrame) -> DataFrame:
    """First likely pass of each family."""
    return first_per_group(passes.where("likely"), ["family"], [F.col("t"), F.col("sat")])
