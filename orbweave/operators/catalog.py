"""Catalog search: coverage, ranking, pass merging, frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import domain, geo
from orbweave.operators.windows import first_per_group, with_group_start

PASS_S = 180.0
MERGED_SOURCES = ("sentinel-2", "sentinel-1", "landsat")


def search(sources: list[DataFrame], area: tuple[float, float, float, float], least: float = 0.0) -> DataFrame:
    """All sources' scenes that touch the area, with their share of it."""
    box = tuple(F.lit(float(v)) for v in area)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    share = F.round(geo.overlap_share(box, (F.col("w"), F.col("s"), F.col("e"), F.col("n_lat"))), 3)
    return rows.withColumn("coverage", F.when(F.col("source") == "wayback", 1.0).otherwise(share)).where((F.col("coverage") > 0) & (F.col("coverage") >= least))


def order_of(sort: str = "best") -> list[Column]:
    """Order columns of a ranking; scene ids break ties."""
    newest, cloud = F.col("time").desc(), F.coalesce("cloud", F.lit(0.0))
    orders = {
        "best": [F.bround(F.log2(F.greatest("gsd", F.lit(0.05))), 0), (F.coalesce("coverage", F.lit(1.0)) < 0.5), (cloud > 50), newest],
        "date": [newest],
        "resolution": [F.col("gsd"), newest],
        "cloud": [cloud, F.col("gsd"), newest],
    }
    if sort not in orders:
        raise ValueError(f"sort must be one of {', '.join(orders)}")
    return [*orders[sort], F.col("scene_id")]


def merge_passes(scenes: DataFrame, limit_s: float = PASS_S) -> DataFrame:
    """Scenes of one overpass as one row: the best-covering scene, the ids of the rest, the union of boxes.

    A pass takes scenes of its (source, platform) up to ``limit_s`` after its first one; scenes of
    other sources than ``MERGED_SOURCES`` stand alone. Passes are found in one sorted pass.
    """
    t = F.unix_micros(F.col("time").cast("timestamp")) / F.lit(1e6)
    alone = F.when(F.col("source").isin(*MERGED_SOURCES), F.lit("")).otherwise(F.col("scene_id"))
    rows = scenes.select("source", "platform", alone.alias("_alone"), t.alias("_t"), "scene_id", "coverage", "w", "s", "e", "n_lat")
    rows = with_group_start(rows, ["source", "platform", "_alone"], "_t", limit_s, ["scene_id"])
    best = F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("c"), F.col("_t").alias("t"), F.col("scene_id").alias("id"))))
    found = rows.groupBy("source", "platform", "_alone", "group_start").agg(
        best.alias("_r"), F.count(F.lit(1)).cast("int").alias("n"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n_lat").alias("n_lat")
    )
    ids = F.transform("_r", lambda x: x["id"])
    return found.select("source", "platform", F.get(ids, F.lit(0)).alias("scene_id"), F.slice(ids, 2, F.greatest(F.size("_r"), F.lit(1))).alias("merged_ids"), "n", "w", "s", "e", "n_lat")


def union_coverage(boxes: DataFrame, by: list[str], area: tuple[float, float, float, float], n: int = 24) -> DataFrame:
    """Share of an n by n grid of sample points of the area inside any of a group's boxes; no join, the points of a box are an array."""
    w, s, e, north = area
    x = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), (F.lit(w) + (i + 0.5) * F.lit(e - w) / n).alias("v")))
    y = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), (F.lit(s) + (i + 0.5) * F.lit(north - s) / n).alias("v")))
    across = F.filter(x, lambda p: p["v"].between(F.col("w"), F.col("e")))
    up = F.filter(y, lambda p: p["v"].between(F.col("s"), F.col("n_lat")))
    inside = F.flatten(F.transform(across, lambda p: F.transform(up, lambda q: p["i"] * n + q["i"])))
    return boxes.select(*by, F.explode(inside).alias("_p")).distinct().groupBy(*by).agg((F.count(F.lit(1)) / F.lit(float(n * n))).alias("coverage"))


def pick_frames(scenes: DataFrame, every: str, least: float = 0.9) -> DataFrame:
    """The clearest, then finest scene of each period among those that cover the area."""
    rows = scenes.where(F.coalesce("coverage", F.lit(1.0)) >= least).withColumn("period", domain.period_key(F.col("time"), every))
    return first_per_group(rows, ["period"], [F.coalesce("cloud", F.lit(0.0)), F.col("gsd"), F.col("time"), F.col("scene_id")])
