"""Scans and writes of the object store, as set operations on frames and Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import geo


def scan(rows: DataFrame, box: tuple | None = None, since: str | None = None, until: str | None = None, site: str | None = None, classes: list[str] | None = None, track: str | None = None, limit: int | None = None) -> DataFrame:
    """Observations in time order under the filters given; plain column predicates, so they reach the Parquet scan."""
    if box is not None:
        rows = rows.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    if since is not None:
        rows = rows.where(F.col("time") >= F.lit(since).cast(rows.schema["time"].dataType))
    if until is not None:
        rows = rows.where(F.col("time") <= F.lit(until).cast(rows.schema["time"].dataType))
    if site is not None:
        rows = rows.where(F.col("site") == site)
    if classes:
        rows = rows.where(F.col("cls").isin(*classes))
    if track is not None:
        rows = rows.where(F.col("track_id") == track)
    return rows.orderBy("time", "obs_id").limit(limit) if limit else rows


def insert_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the table lacks, one per key: what an idempotent append adds."""
    return new.dropDuplicates(key).join(table.select(*key), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The table with new rows in place of old ones of the same key; the highest version wins."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def upsert_keeping(table: DataFrame, new: DataFrame, key: list[str], kept: str) -> DataFrame:
    """``upsert`` that keeps the old value of one column where there is one."""
    old = table.select(*key, F.col(kept).alias("_kept"))
    merged = new.join(old, key, "left").withColumn(kept, F.coalesce("_kept", kept)).drop("_kept")
    return table.join(new.select(*key), key, "left_anti").unionByName(merged.select(*table.columns))


def replace_events(table: DataFrame, new: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """The table after a site's events are replaced, and the events that are new.

    Old events of the site that are not in ``new`` go, but for those of kind ``change_*``; survivors keep
    their rows.
    """
    ids = new.select("event_id")
    stay = table.join(ids, "event_id", "left_semi").unionByName(
        table.join(ids, "event_id", "left_anti").where((F.col("site") != site) | F.col("site").isNull() | F.startswith("kind", F.lit("change_")))
    )
    fresh = insert_ignore(table, new, ["event_id"])
    return stay.unionByName(fresh), fresh


def merge_attributes(rows: DataFrame, patch: DataFrame, key: str, attrs: str = "attrs") -> DataFrame:
    """Rows with their attribute maps overlaid by the patch's, right side winning."""
    over = patch.select(F.col(key), F.col(attrs).alias("_patch"))
    empty = F.create_map().cast("map<string,string>")
    base, top = F.coalesce(F.col(attrs), empty), F.coalesce("_patch", empty)
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k))
    return rows.join(over, key, "left").withColumn(attrs, F.map_concat(kept, top)).drop("_patch")


def write_site(rows: DataFrame, path: str) -> None:
    """Replace whole site partitions, and only those that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)


def located_events(events: DataFrame, sites: DataFrame, box: tuple) -> DataFrame:
    """Events whose own point lies in the box, or whose site's box meets it."""
    area = tuple(F.lit(float(v)) for v in box)
    meets = geo.boxes_meet((F.col("_w"), F.col("_s"), F.col("_e"), F.col("_n")), area)
    boxes = sites.select("site", F.col("w").alias("_w"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("n").alias("_n"))
    inside = F.coalesce(geo.inside(F.col("lat"), F.col("lon"), *area), F.lit(False))
    return events.join(boxes, "site", "left").where(inside | F.coalesce(meets, F.lit(False))).drop("_w", "_s", "_e", "_n")


def geojson(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON point feature per row, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def read_positions(spark, path: str, box: tuple | None = None) -> DataFrame:
    """Position reports from CSV with any of the known headings; rows without mmsi, time or place are skipped."""
    from orbweave.functions.domain import parsed_time

    raw = spark.read.option("header", True).csv(path)
    # Headings by field, lower case.
    names = {
        "mmsi": ["mmsi"], "time": ["basedatetime", "base_date_time", "timestamp", "time", "# timestamp", "datetime"], "lat": ["lat", "latitude"],
        "lon": ["lon", "longitude", "long"], "sog": ["sog", "speed"], "cog": ["cog", "course"], "name": ["vesselname", "vessel_name", "name", "shipname"],
        "length_m": ["length", "length_m"], "vtype": ["vesseltype", "vessel_type", "ship type", "type"],
    }
    have = {c.strip().lower(): c for c in raw.columns}
    pick = {k: next((have[n] for n in options if n in have), None) for k, options in names.items()}
    if missing := [k for k in ("mmsi", "time", "lat", "lon") if pick[k] is None]:
        raise ValueError(f"no column for {', '.join(missing)}")

    def number(name: str) -> Column:
        return F.lit(None).cast("double") if pick[name] is None else F.expr(f"try_cast(trim(`{pick[name]}`) as double)")

    def text(name: str) -> Column:
        return F.lit(None).cast("string") if pick[name] is None else F.trim(F.col(f"`{pick[name]}`"))

    rows = raw.select(
        F.expr(f"try_cast(trim(`{pick['mmsi']}`) as bigint)").alias("mmsi"), parsed_time(F.col(f"`{pick['time']}`")).alias("time"),
        *[number(n).alias(n) for n in ("lat", "lon", "sog", "cog", "length_m")], text("name").alias("name"), text("vtype").alias("vtype"),
    ).where("mmsi is not null and time is not null and lat is not null and lon is not null")
    return rows.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])) if box else rows
