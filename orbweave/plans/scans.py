"""Scans, writes and their read-backs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import domain, geo
from orbweave.operators import store
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql

BOX = (56.05, 26.02, 56.15, 26.12)
_T = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"


def _text_time(df, *columns):
    return df.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")).select(*columns)


@R.add("sc1_observation_scan", f"SELECT obs_id, {_T}, site, cls, lat, lon FROM obs WHERE lon BETWEEN 56.05 AND 56.15 AND lat BETWEEN 26.02 AND 26.12 AND time >= TIMESTAMP '2024-01-05' AND time <= TIMESTAMP '2024-01-20' AND site = 'S1' AND cls IN ('vessel', 'aircraft') ORDER BY obs_id LIMIT 50000")
def sc1(spark, d):
    o = store.scan(fx.observations(spark, d), BOX, "2024-01-05", "2024-01-20", "S1", ["vessel", "aircraft"], limit=50000)
    return _text_time(o, "obs_id", "time", "site", "cls", "lat", "lon")


@R.add("sc2_scene_lookup", f"SELECT scene_id, site, {_T}, source, sensor, gsd, cloud, clear FROM scenes WHERE scene_id = 'S1-2024-01-09'", "scenes")
def sc2(spark, d):
    s = fx.scenes(spark, d).where("scene_id = 'S1-2024-01-09'")
    return _text_time(s, "scene_id", "site", "time", "source", "sensor", "gsd", "cloud", "clear")


@R.add("sc5_sites", "SELECT site, title, region, w, s, e, n, kind FROM sites ORDER BY title", "sites")
def sc5(spark, d):
    return fx.sites(spark, d).orderBy("title")


@R.add("sc6_runs_with_scenes", f"WITH runs AS (SELECT scene_id, site, count(*) AS n FROM obs WHERE cls = 'vessel' GROUP BY scene_id, site) SELECT s.scene_id, s.site, {_T.replace('time,', 's.time,')}, s.source, coalesce(r.n, 0) AS n_runs FROM scenes s LEFT JOIN runs r ON r.scene_id = s.scene_id", "scenes")
def sc6(spark, d):
    runs = fx.observations(spark, d).where("cls = 'vessel'").groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_runs"))
    s = fx.scenes(spark, d).join(runs, "scene_id", "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)).cast("long"))
    return _text_time(s, "scene_id", "site", "time", "source", "n_runs")


@R.add("sc14_first_collection_wins", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY site, cls, strftime(time, '%Y-%m-%d') ORDER BY source DESC, obs_id) AS k FROM obs) SELECT site, cls, strftime(time, '%Y-%m-%d') AS day, source, obs_id FROM t WHERE k = 1")
def sc14(spark, d):
    from orbweave.operators.windows import first_per_group

    o = fx.observations(spark, d).withColumn("day", F.date_format("time", "yyyy-MM-dd"))
    return first_per_group(o, ["site", "cls", "day"], [F.col("source").desc(), F.col("obs_id")]).select("site", "cls", "day", "source", "obs_id")


@R.add("sc17_group_tiles", "SELECT strftime(time, '%Y-%m-%d') AS day, site, count(*) AS n, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n_lat, string_agg(CAST(obs_id AS VARCHAR), ',' ORDER BY obs_id) AS ids FROM obs WHERE cls = 'aircraft' GROUP BY 1, 2")
def sc17(spark, d):
    o = fx.observations(spark, d).where("cls = 'aircraft'")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("obs_id")), lambda x: x.cast("string")), ",")
    return o.groupBy(F.date_format("time", "yyyy-MM-dd").alias("day"), "site").agg(
        F.count(F.lit(1)).alias("n"), F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n_lat"), ids.alias("ids")
    )


@R.add("sc21_acquisitions", "SELECT site, strftime(time, '%Y-%m-%d') AS day, count(*) AS n, min(gsd) AS gsd, round(avg(cloud), 6) AS cloud, min(w) AS w, min(s) AS s, max(e) AS e, max(n_lat) AS n_lat FROM scenes GROUP BY 1, 2", "scenes")
def sc21(spark, d):
    return fx.scenes(spark, d).groupBy("site", F.date_format("time", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("gsd").alias("gsd"), F.round(F.avg("cloud"), 6).alias("cloud"),
        F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n_lat").alias("n_lat"),
    )


@R.add("sc23_distinct_captures", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY site, source, cloud ORDER BY time DESC, scene_id) AS k FROM scenes) SELECT scene_id, site, source, cloud FROM t WHERE k = 1", "scenes")
def sc23(spark, d):
    from orbweave.operators.windows import first_per_group

    return first_per_group(fx.scenes(spark, d), ["site", "source", "cloud"], [F.col("time").desc(), F.col("scene_id")]).select("scene_id", "site", "source", "cloud")


@R.add("sc30_tiles_for_box", "SELECT scene_id, w, s, e, n_lat FROM scenes WHERE NOT (e < 56.05 OR 56.06 < w OR n_lat < 26.05 OR 26.06 < s) AND extract(month FROM time) = 1", "scenes")
def sc30(spark, d):
    box = (56.05, 26.05, 56.06, 26.06)
    area = tuple(F.lit(v) for v in box)
    meets = geo.boxes_meet((F.col("w"), F.col("s"), F.col("e"), F.col("n_lat")), area)
    return fx.scenes(spark, d).where(meets & (F.month("time") == 1)).select("scene_id", "w", "s", "e", "n_lat")


@R.add("sc31_days_covering_point", "SELECT DISTINCT strftime(time, '%Y-%m-%d') AS day FROM scenes WHERE 56.05 BETWEEN w AND e AND 26.05 BETWEEN s AND n_lat", "scenes")
def sc31(spark, d):
    s = fx.scenes(spark, d).where(geo.inside(F.lit(26.05), F.lit(56.05), F.col("w"), F.col("s"), F.col("e"), F.col("n_lat")))
    return s.select(F.date_format("time", "yyyy-MM-dd").alias("day")).distinct().orderBy("day")


@R.add("sc35_tile_names", "SELECT concat(CASE WHEN a < 0 THEN 'S' ELSE 'N' END, lpad(CAST(abs(a) AS VARCHAR), 2, '0'), CASE WHEN o < 0 THEN 'W' ELSE 'E' END, lpad(CAST(abs(o) AS VARCHAR), 3, '0')) AS tile, count(*) AS n FROM (SELECT CAST(floor(lat / 3) * 3 AS BIGINT) AS a, CAST(floor(lon / 3) * 3 AS BIGINT) AS o FROM obs) GROUP BY 1")
def sc35(spark, d):
    a, o = (F.floor(F.col("lat") / 3) * 3), (F.floor(F.col("lon") / 3) * 3)
    name = F.concat(F.when(a < 0, "S").otherwise("N"), F.lpad(F.abs(a).cast("string"), 2, "0"), F.when(o < 0, "W").otherwise("E"), F.lpad(F.abs(o).cast("string"), 3, "0"))
    return fx.observations(spark, d).groupBy(name.alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@R.add("sk1_upsert_latest", "WITH t AS (SELECT track_id, lat, lon, strftime(time, '%Y-%m-%d %H:%M:%S') AS seen, row_number() OVER (PARTITION BY track_id ORDER BY CASE WHEN obs_id % 3 = 0 THEN 1 ELSE 0 END DESC, obs_id DESC) AS k FROM obs) SELECT track_id, lat, lon, seen FROM t WHERE k = 1")
def sk1(spark, d):
    o = fx.observations(spark, d).select("track_id", "obs_id", "lat", "lon", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("seen"))
    return store.upsert(o.where("obs_id % 3 <> 0"), o.where("obs_id % 3 = 0"), ["track_id"], "obs_id").select("track_id", "lat", "lon", "seen")


@R.add("sk2_insert_ignore", "SELECT obs_id, cls FROM obs WHERE obs_id % 2 = 0 AND obs_id % 3 <> 0")
def sk2(spark, d):
    o = fx.observations(spark, d).select("obs_id", "cls")
    return store.insert_ignore(o.where("obs_id % 3 = 0"), o.where("obs_id % 2 = 0"), ["obs_id"])


@R.add("sk3_merge_attributes", "SELECT obs_id, CASE WHEN obs_id % 2 = 0 THEN 'new' ELSE source END AS src, cls AS c FROM obs")
def sk3(spark, d):
    o = fx.observations(spark, d)
    rows = o.select("obs_id", F.create_map(F.lit("src"), F.col("source"), F.lit("c"), F.col("cls")).alias("attrs"))
    patch = o.where("obs_id % 2 = 0").select("obs_id", F.create_map(F.lit("src"), F.lit("new")).alias("attrs"))
    return store.merge_attributes(rows, patch, "obs_id").select("obs_id", F.element_at("attrs", "src").alias("src"), F.element_at("attrs", "c").alias("c"))


@R.add("sk7_upsert_keeping_created", "SELECT site, title, CASE WHEN region % 2 = 0 THEN 'old' ELSE 'new' END AS created FROM sites WHERE region % 2 = 0 OR region > 0", "sites")
def sk7(spark, d):
    s = fx.sites(spark, d)
    table = s.where("region % 2 = 0").select("site", "title", F.lit("old").alias("created"))
    new = s.where("region > 0").select("site", "title", F.lit("new").alias("created"))
    return store.upsert_keeping(table, new, ["site"], "created")


@R.add("sk12_replace_events", "SELECT event_id, site, kind, origin FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, concat('S', CAST(user_id % 5 AS VARCHAR)) AS site, CASE WHEN event_type = 'error' THEN 'change_x' ELSE event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS origin, event_id % 2 = 0 AS was, event_id % 3 = 0 AND user_id % 5 = 1 AS fresh FROM events WHERE event_id % 2 = 0 OR (event_id % 3 = 0 AND user_id % 5 = 1)) WHERE (was AND (fresh OR site <> 'S1' OR kind LIKE 'change_%')) OR (fresh AND NOT was)", "")
def sk12(spark, d):
    e = fx.read(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("site"),
        F.when(F.col("event_type") == "error", "change_x").otherwise(F.col("event_type")).alias("kind"), F.col("event_id").alias("k"),
    )
    old = e.where("k % 2 = 0").select("event_id", "site", "kind", F.lit("old").alias("origin"))
    new = e.where("k % 3 = 0 and site = 'S1'").select("event_id", "site", "kind", F.lit("new").alias("origin"))
    return store.replace_events(old, new, "S1")[0]


@R.add("sk14_positions_once", "SELECT mmsi, strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS t, count(*) AS n FROM ais GROUP BY 1, 2", "ais")
def sk14(spark, d):
    p = fx.positions(spark, d)
    one = p.dropDuplicates(["mmsi", "time"])
    n = p.groupBy("mmsi", "time").agg(F.count(F.lit(1)).alias("n"))
    return one.join(n, ["mmsi", "time"]).select("mmsi", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), "n")


@R.add("sk16_geojson", "SELECT obs_id, concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[', CAST(obs_id AS VARCHAR), ',', CAST(obs_id % 7 AS VARCHAR), ']},\"properties\":{\"cls\":\"', cls, '\"}}') AS feature FROM obs")
def sk16(spark, d):
    o = fx.observations(spark, d).withColumn("lon", F.col("obs_id")).withColumn("lat", F.col("obs_id") % 7)
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return o.select("obs_id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("cls").alias("properties"))).alias("feature"))


@R.add("sk17_alerts", "SELECT obs_id, concat('[', printf('%.2f', sev), '] ', cls, ' at ', site) AS message FROM (SELECT *, CASE WHEN cls = 'vessel' THEN CASE WHEN length_m >= 250 THEN 0.85 WHEN length_m >= 150 THEN 0.6 WHEN length_m >= 80 THEN 0.45 ELSE 0.25 END WHEN cls IN ('aircraft', 'helicopter') THEN 0.6 ELSE 0.2 END AS sev FROM obs) WHERE sev >= 0.5")
def sk17(spark, d):
    o = fx.observations(spark, d).withColumn("sev", domain.object_severity(F.col("cls"), F.col("length_m"))).where("sev >= 0.5")
    return o.select("obs_id", F.format_string("[%.2f] %s at %s", F.col("sev"), F.col("cls"), F.col("site")).alias("message"))


@R.add("sk18_stats", "SELECT 'observations' AS what, count(*) AS n FROM obs UNION ALL SELECT 'scenes', count(*) FROM scenes UNION ALL SELECT 'sites', count(*) FROM sites UNION ALL SELECT 'ais', count(*) FROM ais UNION ALL SELECT concat('cls/', cls), count(*) FROM obs GROUP BY cls", "scenes sites ais")
def sk18(spark, d):
    o = fx.observations(spark, d)
    whole = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    kinds = o.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("cls/"), "cls").alias("what"), "n")
    return whole("observations", o).union(whole("scenes", fx.scenes(spark, d))).union(whole("sites", fx.sites(spark, d))).union(whole("ais", fx.positions(spark, d))).union(kinds)


@R.add("pf3_overlap_share", "SELECT scene_id, round(CASE WHEN dx <= 0 OR dy <= 0 THEN 0 ELSE dx * dy / (CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE)) END, 6) AS share FROM (SELECT scene_id, least(CAST(56.15 AS DOUBLE), e) - greatest(CAST(56.05 AS DOUBLE), w) AS dx, least(CAST(26.15 AS DOUBLE), n_lat) - greatest(CAST(26.05 AS DOUBLE), s) AS dy FROM scenes)", "scenes")
def pf3(spark, d):
    area = tuple(F.lit(v) for v in (56.05, 26.05, 56.15, 26.15))
    return fx.scenes(spark, d).select("scene_id", F.round(geo.overlap_share(area, (F.col("w"), F.col("s"), F.col("e"), F.col("n_lat"))), 6).alias("share"))


@R.add("pf7_events_in_area", "SELECT o.obs_id, o.site FROM obs o LEFT JOIN sites s ON o.site = s.site WHERE (o.lon BETWEEN 56.1 AND 56.2 AND o.lat BETWEEN 26.1 AND 26.2) OR NOT (s.e < 56.1 OR 56.2 < s.w OR s.n < 26.1 OR 26.2 < s.s)", "obs sites")
def pf7(spark, d):
    return store.located_events(fx.observations(spark, d), fx.sites(spark, d), (56.1, 26.1, 56.2, 26.2)).select("obs_id", "site")


@R.add("pf8_usable_scenes", "SELECT scene_id, sensor, gsd FROM scenes WHERE gsd <= 1 AND sensor = 'sar' AND coalesce(cloud, 0) <= 40", "scenes")
def pf8(spark, d):
    return fx.scenes(spark, d).where("gsd <= 1 and sensor = 'sar' and coalesce(cloud, 0) <= 40").select("scene_id", "sensor", "gsd")


@R.add("pf9_detector_route", "SELECT scene_id, CASE WHEN sensor = 'sar' AND gsd < 1 THEN 'sar-fine' WHEN sensor = 'sar' THEN 'cfar' WHEN gsd <= 1 THEN 'objects' ELSE 'ships' END AS detector FROM scenes", "scenes")
def pf9(spark, d):
    route = F.when((F.col("sensor") == "sar") & (F.col("gsd") < 1), "sar-fine").when(F.col("sensor") == "sar", "cfar").when(F.col("gsd") <= 1, "objects").otherwise("ships")
    return fx.scenes(spark, d).select("scene_id", route.alias("detector"))


@R.add("pf10_clear_looks", "SELECT scene_id, coalesce(clear, 1.0) >= 0.85 AS clear_look FROM scenes", "scenes")
def pf10(spark, d):
    from orbweave.operators.events import clear_look

    return fx.scenes(spark, d).select("scene_id", clear_look(F.col("clear")).alias("clear_look"))


@R.add("k6_query_objects", "SELECT strftime(time, '%Y-%m-%d') AS day, source, cls, count(*) AS n FROM obs WHERE lon BETWEEN 56.05 AND 56.15 AND lat BETWEEN 26.02 AND 26.12 AND time >= TIMESTAMP '2024-01-03' GROUP BY 1, 2, 3")
def k6(spark, d):
    o = store.scan(fx.observations(spark, d), BOX, "2024-01-03")
    return o.groupBy(F.date_format("time", "yyyy-MM-dd").alias("day"), "source", "cls").agg(F.count(F.lit(1)).alias("n")).orderBy("day", "source", "cls")
