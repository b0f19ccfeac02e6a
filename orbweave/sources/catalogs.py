"""Reading catalogs: parsers of their records, federated search, indexes that are built once."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import geo

POLARISATIONS = ("HH", "VV", "HV", "VH")


def federated(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all sources that can be read, and what went wrong with the others by name.

    A source is read once here, up to its first row, so that it fails by itself and not the whole search.
    """
    rows, errors = [], {}
    for name, read in sources.items():
        try:
            frame = read()
            frame.limit(1).count()
            rows.append(frame)
        except Exception as error:  # noqa: BLE001 - any fault of a source is reported, none is fatal
            errors[name] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) if rows else None), errors


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Complete versions under a folder, oldest first: a version counts once its job has left ``_SUCCESS``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append((int(name[1:]), s.getPath().toString()))
    return sorted(found)


def publish(rows: DataFrame, root: str) -> str:
    """Write a new version of a table; readers see it whole once its job has committed, and the old one until then."""
    last = [v for v, _ in _versions(rows.sparkSession, root)]
    place = f"{root}/v{max([time.time_ns(), *[v + 1 for v in last]])}"
    rows.write.parquet(place)
    return place


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest complete version of a published table; None before the first."""
    found = _versions(spark, root)
    return spark.read.parquet(found[-1][1]) if found else None


def static_index(spark: SparkSession, root: str, build: Callable[[], DataFrame], max_age_days: float = 30.0, now: float | None = None) -> DataFrame:
    """An index that is built once and again when it is too old; if that fails, the old one serves on."""
    found = _versions(spark, root)
    if found and ((now if now is not None else time.time()) - found[-1][0] / 1e9) < max_age_days * 86400:
        return spark.read.parquet(found[-1][1])
    try:
        publish(build(), root)
    except Exception:  # noqa: BLE001 - a stale index is better than none
        if not found:
            raise
    return current(spark, root)


def index_search(records: DataFrame, area: tuple, since: str, until: str, limit: int = 50) -> DataFrame:
    """Records (w, s, e, n_lat, time) that touch the area within a window, newest first."""
    box = tuple(F.lit(float(v)) for v in area)
    kind = records.schema["time"].dataType
    meets = geo.boxes_meet((F.col("w"), F.col("s"), F.col("e"), F.col("n_lat")), box)
    return records.where(meets & F.col("time").between(F.lit(since).cast(kind), F.lit(until).cast(kind))).orderBy(F.col("time").desc(), "id").limit(limit)


def collects(keys: DataFrame, key: str = "key") -> DataFrame:
    """Directories of a bucket listing that hold an image and a record of it: the first STAC record by name, else the metadata."""
    name, folder = F.regexp_extract(key, "([^/]*)$", 1), F.regexp_extract(key, "^(.*)/[^/]*$", 1)
    rows = keys.select(F.col(key).alias("k"), name.alias("name"), folder.alias("folder"))
    stac = F.col("name").contains(".stac.v2") & F.endswith("name", F.lit(".json"))
    found = rows.groupBy("folder").agg(
        F.max(F.when(F.endswith("name", F.lit("_GEC.tif")), F.col("k"))).alias("image"),
        F.min(F.when(stac, F.col("k"))).alias("stac"),
        F.max(F.when(F.endswith("name", F.lit("_METADATA.json")), F.col("k"))).alias("metadata"),
    )
    return found.where("image is not null and (stac is not null or metadata is not null)").select(
        "folder", F.regexp_extract("folder", "([^/]*)$", 1).alias("id"), "image", F.coalesce("stac", "metadata").alias("record"), F.col("stac").isNotNull().alias("is_stac")
    )


def _largest(*values: Column) -> Column:
    """The largest of the values that are neither null nor zero, to two decimals."""
    some = F.filter(F.array(*values), lambda x: x.isNotNull() & (x != 0))
    return F.when(F.size(some) > 0, F.round(F.array_max(some), 2))


def stac_record(doc: Column) -> Column:
    """Struct of a STAC item as text: time, box (of four or six numbers), resolution, platform; null without time or box."""
    d = F.from_json(doc, "bbox array<double>, properties map<string,string>")
    p = lambda name: F.element_at(d["properties"], name)
    at = lambda i: F.get(d["bbox"], F.lit(i))
    long = F.size(d["bbox"]) == 6
    res = _largest(p("umbra:best_resolution_range_meters").cast("double"), p("umbra:best_resolution_azimuth_meters").cast("double"))
    made = F.struct(
        p("datetime").alias("time"), at(0).alias("w"), at(1).alias("s"), F.when(long, at(3)).otherwise(at(2)).alias("e"), F.when(long, at(4)).otherwise(at(3)).alias("n_lat"),
        F.coalesce(res, F.lit(0.5)).alias("gsd"), p("platform").alias("platform"),
    )
    return F.when((F.size(d["bbox"]) > 0) & (F.coalesce(p("datetime"), F.lit("")) != ""), made)


def metadata_record(doc: Column) -> Column:
    """Struct of an older metadata document as text: the footprint's ring gives the box; null without one."""
    d = F.from_json(doc, "collects array<struct<startAtUTC:string,footprintPolygonLla:struct<coordinates:array<array<array<double>>>>>>, targetIpr double, baseIpr double, umbraSatelliteName string")
    first = F.get(d["collects"], F.lit(0))
    ring = F.get(first["footprintPolygonLla"]["coordinates"], F.lit(0))
    xs, ys = F.transform(ring, lambda q: F.get(q, F.lit(0))), F.transform(ring, lambda q: F.get(q, F.lit(1)))
    known = lambda c: F.when(c != 0, c)
    made = F.struct(
        first["startAtUTC"].alias("time"), F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n_lat"),
        F.coalesce(known(d["targetIpr"]), known(d["baseIpr"]), F.lit(0.5)).alias("gsd"), d["umbraSatelliteName"].alias("platform"),
    )
    return F.when(F.size(ring) > 0, made)


def capella_record(doc: Column) -> Column:
    """Struct of a Capella item as text: the first asset of a polarisation that has a link, and the coarser resolution, else the pixel spacing."""
    d = F.from_json(doc, "id string, bbox array<double>, properties map<string,string>, assets map<string,struct<href:string>>")
    p = lambda name: F.element_at(d["properties"], name)
    linked = F.filter(F.map_entries(d["assets"]), lambda a: a["key"].isin(*POLARISATIONS) & (F.coalesce(a["value"]["href"], F.lit("")) != ""))
    res = _largest(p("capella:resolution_ground_range").cast("double"), p("sar:resolution_azimuth").cast("double"))
    made = F.struct(
        d["id"].alias("id"), p("datetime").alias("time"), F.get(linked, F.lit(0))["value"]["href"].alias("href"),
        F.coalesce(res, p("sar:pixel_spacing_range").cast("double"), F.lit(0.5)).alias("gsd"), p("sar:instrument_mode").alias("mode"), p("sat:orbit_state").alias("orbit"),
    )
    return F.when(F.size(linked) > 0, made)


def releases(rows: DataFrame) -> DataFrame:
    """Basemap releases (release, title, url): the date in the title, the tile address in common form, newest first; undated ones go."""
    url = F.replace(F.replace(F.replace("url", F.lit("{level}"), F.lit("{z}")), F.lit("{row}"), F.lit("{y}")), F.lit("{col}"), F.lit("{x}"))
    dated = rows.select("release", F.regexp_extract("title", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("date"), "title", url.alias("tiles"))
    return dated.where("date <> ''").orderBy(F.col("date").desc(), "release")


def element_sets(lines: DataFrame, by: str = "file", order: str = "line", text: str = "value") -> DataFrame:
    """Pairs of element lines by catalogue number from text files; blank lines do not count, the last pair of a number wins."""
    rows = lines.withColumn("_t", F.rtrim(F.col(text))).where("_t <> ''")
    w = Window.partitionBy(by).orderBy(order)
    pairs = rows.withColumn("_next", F.lead("_t").over(w)).where(F.startswith("_t", F.lit("1 ")) & F.startswith("_next", F.lit("2 ")))
    pairs = pairs.select(F.expr("try_cast(trim(substring(_t, 3, 5)) as int)").alias("norad"), F.struct(by, order).alias("_o"), F.col("_t").alias("line1"), F.col("_next").alias("line2"))
    return pairs.where("norad is not null").groupBy("norad").agg(F.max_by("line1", "_o").alias("line1"), F.max_by("line2", "_o").alias("line2"))


def mosaic(pixels: DataFrame, key: list[str], bands: list[str], priority: str) -> DataFrame:
    """Per pixel and band the value of the first source that has one, in order of ``priority``."""
    return pixels.groupBy(*key).agg(*[F.min_by(b, F.when(F.col(b).isNotNull() & ~F.isnan(b), F.col(priority))).alias(b) for b in bands])


def tile_index(tiles: DataFrame, prefix: str, address: str) -> DataFrame:
    """Tiles (path, year, crs, wgs84_*) as an index by box, their paths as web addresses."""
    box = [F.col(f"wgs84_{n}").cast("double").alias(c) for n, c in (("west", "w"), ("south", "s"), ("east", "e"), ("north", "n_lat"))]
    path = F.when(F.startswith("path", F.lit(prefix)), F.concat(F.lit(address), F.substring("path", len(prefix) + 1, 1 << 20))).otherwise(F.col("path"))
    return tiles.select(path.alias("url"), F.col("year").cast("int").alias("year"), "crs", *box)


def water(pixels: DataFrame, cover: DataFrame, key: list[str], reached: bool = True, water_class: int = 80) -> DataFrame:
    """Water where no land-cover tile shows another class; pixels without a tile are open sea, and nothing is known where no cover could be read."""
    land = cover.where(F.col("class").isNotNull()).groupBy(*key).agg(F.max((F.col("class") != water_class).cast("int")).alias("_land"))
    rows = pixels.select(*key).join(land, key, "left")
    return rows.withColumn("water", F.coalesce(F.col("_land") == 0, F.lit(True)) if reached else F.lit(None).cast("boolean")).drop("_land")
