"""A site's refresh as one job, the guard against doing work twice, and sweeps whose failures stay apart."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import geo
from orbweave.operators import ais, desk, events, store, tracking
from orbweave.sources import catalogs
from orbweave.sources.paths import cut


def refresh_sites(obs: DataFrame, scenes: DataFrame, reports: DataFrame | None, area_m2: float) -> dict[str, DataFrame]:
    """Everything that follows from the stored sightings, rebuilt: ``matches``, ``links``, ``tracks`` and ``events``.

    All sites at once: what is per site is keyed by it, distances are in the plane of the site's centre, and the scenes'
    boxes say what an image could not have missed. Sightings without reports near them are neither
    matched nor dark. ``replaced`` takes the result into the stored tables.
    """
    boxed = {"w", "s", "e", "n_lat"} <= set(scenes.columns)
    links = cut(tracking.build_tracks(obs, area_m2, scenes.select("scene_id", "w", "s", "e", "n_lat") if boxed else None))
    chosen = links.where("chosen = 1").select(F.col("obs_id").alias("_obs"), "track_id", "prob")
    seen = cut(obs.drop("track_id").join(chosen, F.col("obs_id").cast("string") == F.col("_obs")).drop("_obs"))
    status = links.where("chosen = 1").select("site", "track_id", "status").distinct()
    summary = tracking.track_summary(seen, ["site", "track_id"]).join(status, ["site", "track_id"])
    tracks = cut(summary)
    centre = seen.groupBy("site").agg(F.avg("lat").alias("_lat0"), F.avg("lon").alias("_lon0"))
    local = seen.join(centre, "site").withColumn("x", geo.local_x(F.col("lon"), F.col("_lat0"), F.col("_lon0"))).withColumn("y", geo.local_y(F.col("lat"), F.col("_lat0"))).drop("_lat0", "_lon0")
    families = [
        events.turnover(seen, tracks, scenes),
        events.track_events(tracks),
        events.task_groups(local, scenes),
        events.count_anomalies(seen.join(scenes.where(events.clear_look(F.col("clear"))).select("scene_id"), "scene_id", "left_semi")),
        events.unusual_locations(seen, scenes).withColumn("kind", F.lit("unusual_location")),
        events.sts_candidates(seen, scenes).withColumn("kind", F.lit("sts_candidate")).join(scenes.select("scene_id", "site"), "scene_id"),
        events.fat_hulls(seen).withColumn("kind", F.lit("sts_candidate")).join(scenes.select("scene_id", "site"), "scene_id"),
    ]
    out = {"links": links, "tracks": tracks}
    if reports is not None:
        out["matches"] = cut(ais.match(obs, reports))
        families.append(events.dark_vessels(seen, out["matches"]))
    return out | {"events": cut(events.all_events(*families))}


def replaced(spark: SparkSession, root: str, out: dict[str, DataFrame]) -> DataFrame:
    """Take a refresh into the stored ``links``, ``tracks`` and ``events`` below ``root``; returns the events that are new.

    Whole site partitions are replaced, of the sites that the refresh has rows of, so a crash between
    the writes is mended by the next run and a second run changes nothing. Of a site's old events those
    that did not come again go, but for changes of the ground; survivors keep their rows.
    """
    for name in ("links", "tracks"):
        store.write_site(out[name], f"{root}/{name}")
    new = out["events"].dropDuplicates(["event_id"])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/events")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        store.write_site(new, f"{root}/events")
        return new
    table = spark.read.schema(new.schema).parquet(f"{root}/events")
    sites = out["tracks"].select("site").distinct()
    old = table.join(sites, "site", "left_semi")
    stay = old.join(new.select("event_id"), "event_id", "left_semi").unionByName(old.join(new.select("event_id"), "event_id", "left_anti").where(F.startswith("kind", F.lit("change_"))))
    fresh = cut(store.insert_ignore(table, new, ["event_id"]))
    rows = cut(stay.unionByName(fresh))
    # A site that is left without events writes no partition, so its old folder goes; there is one a site.
    placed = table.select("site", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
    bare = placed.join(sites, "site", "left_semi").join(rows.select("site").distinct(), "site", "left_anti").collect()
    store.write_site(rows, f"{root}/events")
    for r in bare:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["folder"]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return fresh


def process(spark: SparkSession, root: str, scenes: DataFrame, detect: Callable[[DataFrame], DataFrame], error: str | None = None) -> DataFrame:
    """Detect in the scenes that no run has ended well for, store the new sightings and record the runs; returns those scenes.

    ``scenes`` has ``site``, ``scene_id`` and ``detector``. The sightings are published before the runs, each
    as a whole version: a crash between the two makes the scenes run again, and as sightings are inserted by
    their key that changes nothing.
    """
    runs = catalogs.current(spark, f"{root}/runs")
    todo = cut(scenes if runs is None else desk.unprocessed(scenes, runs))
    found = detect(todo)
    known = catalogs.current(spark, f"{root}/observations")
    rows = found.dropDuplicates(["obs_id"]) if known is None else known.unionByName(found.dropDuplicates(["obs_id"]).join(known.select("obs_id"), "obs_id", "left_anti").select(*known.columns))
    catalogs.publish(rows, f"{root}/observations")
    number = 0 if runs is None else (runs.agg(F.max("finished")).first()[0] or 0) + 1
    new = todo.select("site", "scene_id", "detector", F.lit("ok" if error is None else "error").alias("status"), F.lit(number).cast("long").alias("finished"))
    catalogs.publish(new if runs is None else desk.record_runs(runs, new), f"{root}/runs")
    return todo


def each_site(sites: list[str], job: Callable[[str], DataFrame], at_once: int = 4) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of what ``job`` gives for every site, and the errors of those that failed; Spark runs a few sites' jobs together."""
    errors: dict[str, str] = {}

    def one(site: str) -> DataFrame | None:
        try:
            return cut(job(site))
        except Exception as error:  # noqa: BLE001 - a site's fault is told and the others go on
            errors[site] = f"{type(error).__name__}: {error}".splitlines()[0]
            return None

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        rows = [r for r in pool.map(one, sites) if r is not None]
    return (reduce(DataFrame.unionByName, rows) if rows else None), errors


def add_preset(sites: DataFrame, preset: DataFrame) -> DataFrame:
    """The sites table with those of a preset (site, kind, lat, lon, radius_km), boxes around their points; known sites are replaced."""
    box = dict(zip(("w", "s", "e", "n"), geo.box_of(F.col("lat"), F.col("lon"), F.col("radius_km")), strict=True))
    made = preset.withColumns(box)
    rows = made.select(*[F.col(c).cast(t).alias(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in sites.dtypes])
    return sites.join(rows.select("site"), "site", "left_anti").select(*sites.columns).unionByName(rows)
