"""Queries of parsers, catalogs and smaller scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orbweave.functions import domain, geo, text
from orbweave.operators import store
from orbweave.plans.common import Registry
from orbweave.sources import catalogs
from orbweave.sources import fixtures as fx
from orbweave.sources.paths import shared_folder

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _place(spark, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


_ASKED = """q AS (SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN concat('ships near ', name, ' today') WHEN 1 THEN concat('what is at 2', CAST(n_nationkey % 7 AS VARCHAR), '.5, -5', CAST(n_nationkey % 4 AS VARCHAR), '.25?')
 WHEN 2 THEN concat('show \"', name, ' port\" please') WHEN 3 THEN 'Grand Harbour traffic or Port Said' ELSE 'nothing here' END AS t, name FROM (SELECT *, concat('Port ', chr(CAST(65 + n_nationkey % 26 AS INTEGER)), 'ara') AS name FROM nation))"""


@R.add("f33_places", f"WITH {_ASKED} SELECT k, CASE k % 5 WHEN 0 THEN name WHEN 1 THEN concat('2', CAST(k % 7 AS VARCHAR), '.5,-5', CAST(k % 4 AS VARCHAR), '.25') WHEN 2 THEN concat(name, ' port') WHEN 3 THEN 'Grand Harbour' END AS place FROM q", "")
def f33(spark, d):
    n = fx.read(spark, d, "nation")
    k = F.col("n_nationkey").cast("int")
    name = F.concat(F.lit("Port "), F.char(65 + k % 26), F.lit("ara"))
    t = (
        F.when(k % 5 == 0, F.concat(F.lit("ships near "), name, F.lit(" today")))
        .when(k % 5 == 1, F.concat(F.lit("what is at 2"), (k % 7).cast("string"), F.lit(".5, -5"), (k % 4).cast("string"), F.lit(".25?")))
        .when(k % 5 == 2, F.concat(F.lit('show "'), name, F.lit(' port" please')))
        .when(k % 5 == 3, F.lit("Grand Harbour traffic or Port Said"))
        .otherwise(F.lit("nothing here"))
    )
    return n.select(k.alias("k"), text.place_of(t).alias("place"))


@R.add("f2_tiff_time", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time FROM events", "")
def f2(spark, d):
    e = fx.read(spark, d, "events")
    form = F.when(F.col("event_id") % 4 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return e.select("event_id", F.date_format(domain.tiff_time(form), "yyyy-MM-dd HH:mm:ss").alias("time"))


@R.add("f4_since", "SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 1 HOUR * (event_id % 50) WHEN 1 THEN TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 1 DAY * (event_id % 9) WHEN 2 THEN TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 7 DAY * (event_id % 3) WHEN 3 THEN TIMESTAMP '2024-01-25 12:00:00' ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS since FROM events", "")
def f4(spark, d):
    e = F.col("event_id")
    s = lambda n, u: F.concat((e % n).cast("string"), F.lit(u))
    form = F.when(e % 5 == 0, s(50, "h")).when(e % 5 == 1, s(9, "D ")).when(e % 5 == 2, s(3, "w")).when(e % 5 == 4, F.date_format("ts", "yyyy-MM-dd"))
    now = F.to_timestamp(F.lit("2024-02-01 12:00:00"))
    return fx.read(spark, d, "events").select("event_id", F.date_format(domain.since(form, now), "yyyy-MM-dd HH:mm:ss").alias("since"))


@R.add("f5_date_window", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat(CASE WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE '2024-01-02 12:00:00' END, ' ', CASE WHEN event_id % 3 = 1 THEN strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d 23:59:59') ELSE '2024-02-01 12:00:00' END) END AS win FROM events", "")
def f5(spark, d):
    e, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    start = F.when(e % 3 == 0, F.lit("2024-03-05")).when(e % 3 == 1, day)
    end = F.when(e % 3 == 0, F.lit("2024-03-01")).when(e % 3 == 1, F.date_format(F.col("ts") + F.expr("interval 2 days"), "yyyy-MM-dd"))
    w = domain.date_window(start, end, F.to_timestamp(F.lit("2024-02-01 12:00:00")))
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return fx.read(spark, d, "events").select("event_id", w.alias("w")).select("event_id", F.when(F.col("w").isNotNull(), F.concat(t("w.since"), F.lit(" "), t("w.until"))).alias("win"))


@R.add("f11_box_around", "SELECT obs_id, round(lon - 5000 / (111320.0::DOUBLE * cos(radians(lat))), 6) AS w, round(lat + 5000 / 110574.0::DOUBLE, 6) AS n, round(10000 / (111320.0::DOUBLE * cos(radians(lat))) * 111.32::DOUBLE * cos(radians(lat)), 4) AS width_km FROM obs WHERE cls = 'vessel'")
def f11(spark, d):
    w, s, e, n = geo.box_of(F.col("lat"), F.col("lon"), F.lit(5.0))
    return fx.observations(spark, d).where("cls = 'vessel'").select("obs_id", F.round(w, 6).alias("w"), F.round(n, 6).alias("n"), F.round(geo.size_km(w, s, e, n)[0], 4).alias("width_km"))


@R.add("f14_areas", "SELECT obs_id, CASE obs_id % 4 WHEN 0 THEN round(lat - 10000 / 110574.0::DOUBLE, 6) WHEN 1 THEN 26.0 END AS s, CASE obs_id % 4 WHEN 0 THEN round(lat + 10000 / 110574.0::DOUBLE, 6) WHEN 1 THEN 26.5 END AS n FROM obs")
def f14(spark, d):
    k = F.col("obs_id") % 4
    what = F.when(k == 0, F.concat(F.format_string("%.6f", "lat"), F.lit(", "), F.format_string("%.6f", "lon"))).when(k == 1, F.lit("56.0,26.0,56.5,26.5")).when(k == 2, F.lit("95.0, 10.0")).otherwise(F.lit("Port Said"))
    return fx.observations(spark, d).select("obs_id", geo.area_of(what).alias("a")).select("obs_id", F.round("a.s", 6).alias("s"), F.round("a.n", 6).alias("n"))


@R.add("pf15_area_guard", "SELECT scene_id, greatest((e - w) * 111.32::DOUBLE * cos(radians((s + n_lat) / 2)), (n_lat - s) * 110.574::DOUBLE) > 13 AS too_large FROM scenes", "scenes")
def pf15(spark, d):
    return fx.scenes(spark, d).select("scene_id", geo.too_large(F.col("w"), F.col("s"), F.col("e"), F.col("n_lat"), 6.0).alias("too_large"))


@R.add("f15_quadkeys", "SELECT k, (-9740000.0::DOUBLE + x * 20480000.0::DOUBLE / 64) AS w, (10240000.0::DOUBLE - y * 20480000.0::DOUBLE / 64) AS n FROM (SELECT DISTINCT l_orderkey % 4096 AS k FROM lineitem), (SELECT j, list_sum(list_transform(range(0, 6), lambda i: ((j >> (2 * i)) & 1) << i)) AS x, list_sum(list_transform(range(0, 6), lambda i: ((j >> (2 * i + 1)) & 1) << i)) AS y FROM range(4096) t(j)) WHERE j = k", "")
def f15(spark, d):
    k = fx.read(spark, d, "lineitem").select((F.col("l_orderkey") % 4096).alias("k")).distinct()
    digit = lambda i: F.shiftright(F.col("k"), 2 * i).bitwiseAND(3).cast("string")
    w, _, _, n = geo.quadkey_box(F.concat(*[digit(i) for i in range(5, -1, -1)]))
    return k.select("k", w.alias("w"), n.alias("n"))


@R.add("f25_knots", "SELECT obs_id, round(value * CAST(1.943844 AS DOUBLE), 4) AS kn FROM obs WHERE cls = 'vessel'")
def f25(spark, d):
    return fx.observations(spark, d).where("cls = 'vessel'").select("obs_id", F.round(domain.knots(F.col("value")), 4).alias("kn"))


@R.add("f39_family_table", "SELECT obs_id, family, stay, top_speed, persistence_days FROM (SELECT obs_id, CASE cls WHEN 'storage-tank' THEN 'tank' ELSE cls END AS family FROM obs) JOIN (VALUES ('vessel', 0.4, 18.0, 5.0), ('aircraft', 0.7, 300.0, 20.0), ('vehicle', 0.4, 40.0, 1.0), ('tank', 0.99, 0.0, 3650.0), ('other', 0.95, 0.0, 365.0)) t(family, stay, top_speed, persistence_days) USING (family)")
def f39(spark, d):
    o = fx.observations(spark, d).select("obs_id", domain.family(F.col("cls")).alias("family"))
    return o.join(F.broadcast(domain.family_table(spark)), "family").select("obs_id", "family", "stay", "top_speed", "persistence_days")  # five rows


@R.add("r36_pass_scales", "SELECT scene_id, CASE WHEN gsd <= 0.7 THEN '0.30,0.75' ELSE printf('%.2f', gsd) END AS scales FROM scenes", "scenes")
def r36(spark, d):
    listed = F.array_join(F.transform(domain.pass_scales(F.col("gsd")), lambda x: F.format_string("%.2f", x)), ",")
    return fx.scenes(spark, d).select("scene_id", listed.alias("scales"))


@R.add("u4_links_in_order", "WITH l AS (SELECT o_orderkey AS k, [o_custkey % 3, o_orderkey % 3, o_custkey % 2, o_orderkey % 5] AS l FROM orders) SELECT k, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS kept FROM l", "")
def u4(spark, d):
    o = fx.read(spark, d, "orders")
    values = F.array(F.col("o_custkey") % 3, F.col("o_orderkey") % 3, F.col("o_custkey") % 2, F.col("o_orderkey") % 5)
    return o.select(F.col("o_orderkey").alias("k"), F.array_join(text.kept_in_order(values), ",").alias("kept"))


# ------------------------------------------------------------------ catalogs


@R.add("sc9_position_csv", "SELECT mmsi, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, round(lat, 6) AS lat, sog FROM ais WHERE mmsi % 7 <> 3 AND lat BETWEEN 26.02 AND 26.12 AND lon BETWEEN 56.05 AND 56.15", "ais")
def sc9(spark, d):
    """Reports written as CSV with other headings and bad cells, and read back: rows without a number, time or place are skipped."""
    p, place = fx.positions(spark, d), _place(spark, "reports")
    rows = p.select(
        F.when(F.col("mmsi") % 7 == 3, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("mmsi").cast("string"))).alias("MMSI"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("BaseDateTime"),
        F.col("lat").cast("string").alias("LAT"), F.col("lon").cast("string").alias("LON"), F.coalesce(F.col("sog").cast("string"), F.lit("-")).alias("SOG"), F.col("cog").cast("string").alias("COG"),
    )
    rows.write.option("header", True).csv(place)
    r = store.read_positions(spark, place, (56.05, 26.02, 56.15, 26.12))
    return r.select("mmsi", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.round("lat", 6).alias("lat"), "sog")


@R.add("sc11_federated_search", "SELECT scene_id, source FROM scenes WHERE sensor = 'optical' UNION ALL SELECT concat('r-', scene_id), 'radar' FROM scenes WHERE sensor = 'sar'", "scenes")
def sc11(spark, d):
    """Three catalogs of which one cannot be read: the other two answer."""
    s = fx.scenes(spark, d)
    found, errors = catalogs.federated(
        {
            "optical": lambda: s.where("sensor = 'optical'").select("scene_id", "source"),
            "broken": lambda: spark.read.parquet(f"{_place(spark, 'nowhere')}"),
            "radar": lambda: s.where("sensor = 'sar'").select(F.concat(F.lit("r-"), "scene_id").alias("scene_id"), F.lit("radar").alias("source")),
        }
    )
    assert list(errors) == ["broken"]
    return found


_BOXED = "SELECT scene_id AS id, strftime(time, '%Y-%m-%d') AS day FROM scenes WHERE NOT (e < 56.05 OR 56.06 < w OR n_lat < 26.05 OR 26.06 < s) AND time BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-26' ORDER BY time DESC, scene_id LIMIT 50"


@R.add("sc13_static_index", _BOXED, "scenes")
def sc13(spark, d):
    """An index built once, then too old and not to be rebuilt: the stale one serves the search (also SC18)."""
    place = _place(spark, "index")
    build = lambda: fx.scenes(spark, d).select(F.col("scene_id").alias("id"), "time", "w", "s", "e", "n_lat")
    catalogs.static_index(spark, place, build)
    rows = catalogs.static_index(spark, place, lambda: spark.read.parquet(f"{place}/missing"), 0.0)
    return catalogs.index_search(rows, (56.05, 26.05, 56.06, 26.06), "2024-01-04", "2024-01-26").select("id", F.date_format("time", "yyyy-MM-dd").alias("day"))


@R.add("sk15_published_table", "SELECT scene_id, site FROM scenes WHERE sensor = 'sar'", "scenes")
def sk15(spark, d):
    """A version that fails half-way is never seen; the last complete one is."""
    place, s = _place(spark, "table"), fx.scenes(spark, d).select("scene_id", "site", "sensor")
    catalogs.publish(s.where("sensor = 'optical'"), place)
    catalogs.publish(s.where("sensor = 'sar'"), place)
    s.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{place}/v{2**62}")
    return catalogs.current(spark, place).select("scene_id", "site")


@R.add("sc19_collects", "SELECT concat('sar/', site, '/', scene_id) AS folder, scene_id AS id, CASE WHEN extract(day FROM time) % 3 = 1 THEN concat('sar/', site, '/', scene_id, '/a_METADATA.json') ELSE concat('sar/', site, '/', scene_id, '/a.stac.v2.json') END AS record FROM scenes WHERE extract(day FROM time) % 3 <> 2", "scenes")
def sc19(spark, d):
    s, k = fx.scenes(spark, d), F.dayofmonth("time") % 3
    base = F.concat(F.lit("sar/"), "site", F.lit("/"), "scene_id", F.lit("/"))
    both = F.array(F.lit("a_GEC.tif"), F.lit("a.stac.v2.json"), F.lit("a_METADATA.json"))
    names = F.when(k == 0, both).when(k == 1, F.array(F.lit("a_GEC.tif"), F.lit("a_METADATA.json"))).otherwise(F.array(F.lit("a_GEC.tif")))
    return catalogs.collects(s.select(F.explode(F.transform(names, lambda n: F.concat(base, n))).alias("key"))).select("folder", "id", "record")


@R.add("sc20_records", "SELECT scene_id, w, s, e, n_lat, CASE WHEN extract(day FROM time) % 2 = 0 THEN 0.5 ELSE gsd END AS gsd FROM scenes", "scenes")
def sc20(spark, d):
    """Odd days as STAC items with boxes of six numbers, even days as metadata documents with a footprint ring."""
    s = fx.scenes(spark, d)
    n = lambda c: F.col(c).cast("string")
    stac = F.concat(F.lit('{"bbox":['), F.concat_ws(",", n("w"), n("s"), F.lit("0"), n("e"), n("n_lat"), F.lit("9")), F.lit('],"properties":{"datetime":"2024","umbra:best_resolution_range_meters":'), n("gsd"), F.lit(',"umbra:best_resolution_azimuth_meters":0}}'))
    at = lambda x, y: F.concat(F.lit("["), n(x), F.lit(","), n(y), F.lit(",3.5]"))
    old = F.concat(F.lit('{"collects":[{"startAtUTC":"2024","footprintPolygonLla":{"coordinates":[['), F.concat_ws(",", at("w", "s"), at("e", "s"), at("e", "n_lat"), at("w", "n_lat"), at("w", "s")), F.lit("]]}}]}"))
    odd = F.dayofmonth("time") % 2 == 1
    rows = s.select("scene_id", F.when(odd, catalogs.stac_record(stac)).otherwise(catalogs.metadata_record(old)).alias("r"))
    return rows.select("scene_id", "r.w", "r.s", "r.e", "r.n_lat", "r.gsd")


@R.add("sc22_capella_items", "SELECT scene_id AS id, concat('http://x/', scene_id, '.tif') AS href, CASE WHEN extract(day FROM time) % 3 = 1 THEN 0.7 ELSE gsd END AS gsd FROM scenes WHERE extract(day FROM time) % 3 <> 2", "scenes")
def sc22(spark, d):
    s, k = fx.scenes(spark, d), F.dayofmonth("time") % 3
    asset = F.when(k == 2, F.lit('"thumbnail":{"href":"t"},"HH":{"href":""}')).otherwise(F.concat(F.lit('"thumbnail":{"href":"t"},"VV":{"href":"http://x/'), "scene_id", F.lit('.tif"}')))
    res = F.when(k == 1, F.lit('"sar:pixel_spacing_range":0.7')).otherwise(F.concat(F.lit('"capella:resolution_ground_range":0.1,"sar:resolution_azimuth":'), F.col("gsd").cast("string")))
    doc = F.concat(F.lit('{"id":"'), "scene_id", F.lit('","bbox":[1,2,3,4],"properties":{"datetime":"2024",'), res, F.lit('},"assets":{'), asset, F.lit("}}"))
    return s.select(catalogs.capella_record(doc).alias("r")).where("r is not null").select("r.id", "r.href", "r.gsd")


@R.add("sc24_releases", "SELECT row_number() OVER (ORDER BY scene_id) AS release, strftime(time, '%Y-%m-%d') AS date, 'http://t/{z}/{y}/{x}' AS tiles FROM scenes WHERE site <> 'S4' QUALIFY true", "scenes")
def sc24(spark, d):
    from pyspark.sql import Window

    s = fx.scenes(spark, d).withColumn("release", F.row_number().over(Window.orderBy(F.col("site") == "S4", "scene_id")))
    title = F.when(F.col("site") == "S4", F.lit("World imagery, undated")).otherwise(F.concat(F.lit("World imagery (Wayback "), F.date_format("time", "yyyy-MM-dd"), F.lit(")")))
    return catalogs.releases(s.select("release", title.alias("title"), F.lit("http://t/{level}/{row}/{col}").alias("url"))).select(F.col("release").cast("long").alias("release"), "date", "tiles")


_PIECES = "p AS (SELECT l_orderkey % 64 AS r, l_partkey % 64 AS c, l_linenumber AS k, l_orderkey AS o, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_tax END AS a, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_discount END AS b FROM lineitem)"


@R.add("sc27_mosaic", f"WITH {_PIECES} SELECT r, c, round(arg_min(a, (k, o)) FILTER (a IS NOT NULL), 6) AS a, round(arg_min(b, (k, o)) FILTER (b IS NOT NULL), 6) AS b FROM (SELECT r, c, k, o, min(a) AS a, min(b) AS b FROM p GROUP BY 1, 2, 3, 4) GROUP BY 1, 2", "")
def sc27(spark, d):
    """First valid value by priority, each band by itself (also SC28: holes are filled from the next granule)."""
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    p = fx.read(spark, d, "lineitem").select((o % 64).alias("r"), (F.col("l_partkey") % 64).alias("c"), F.struct("l_linenumber", "l_orderkey").alias("k"), F.when(s % 3 != 0, F.col("l_tax")).alias("a"), F.when(s % 5 != 0, F.col("l_discount")).alias("b"))
    p = p.groupBy("r", "c", "k").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    return catalogs.mosaic(p, ["r", "c"], ["a", "b"], "k").select("r", "c", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@R.add("sc29_tile_index", "SELECT concat('https://data/', scene_id, '.tif') AS url, CAST(extract(year FROM time) AS INTEGER) AS year, w, n_lat FROM scenes", "scenes")
def sc29(spark, d):
    t = fx.scenes(spark, d).select(
        F.concat(F.lit("s3://store/"), "scene_id", F.lit(".tif")).alias("path"), F.year("time").alias("year"), F.lit("EPSG:32640").alias("crs"),
        F.col("w").alias("wgs84_west"), F.col("s").alias("wgs84_south"), F.col("e").alias("wgs84_east"), F.col("n_lat").alias("wgs84_north"),
    )
    return catalogs.tile_index(t, "s3://store/", "https://data/").select("url", "year", "w", "n_lat")


@R.add("sc34_element_sets", "SELECT n_nationkey + 40000 AS norad, concat('1 ', CAST(n_nationkey + 40000 AS VARCHAR), 'U new') AS line1, concat('2 ', CAST(n_nationkey + 40000 AS VARCHAR), ' second') AS line2 FROM nation WHERE n_nationkey % 4 <> 3", "")
def sc34(spark, d):
    """Element lines in text files: names, blank lines and first lines without a second one are passed over."""
    n, place = fx.read(spark, d, "nation"), _place(spark, "elements")
    k = (F.col("n_nationkey") + 40000).cast("string")
    lines = F.array(F.concat(F.lit("SAT "), k), F.concat(F.lit("1 "), k, F.lit("U old")), F.lit(""), F.concat(F.lit("1 "), k, F.lit("U new  ")), F.concat(F.when(F.col("n_nationkey") % 4 == 3, F.lit("3 ")).otherwise(F.lit("2 ")), k, F.lit(" second")))
    n.select(F.array_join(lines, "\n").alias("value")).write.text(place)
    files = spark.read.text(place, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return catalogs.element_sets(files).select(F.col("norad").cast("int").alias("norad"), "line1", "line2")


@R.add("sc36_water_mask", "SELECT i, coalesce(bool_and(class = 80), true) AS water FROM (SELECT DISTINCT l_orderkey % 500 AS i FROM lineitem) LEFT JOIN (SELECT l_orderkey % 500 AS j, CASE WHEN l_partkey % 7 = 0 THEN 10 ELSE 80 END AS class FROM lineitem WHERE l_orderkey % 500 >= 100) ON i = j GROUP BY i", "")
def sc36(spark, d):
    l = fx.read(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("i"), F.when(F.col("l_partkey") % 7 == 0, 10).otherwise(80).alias("class"))
    return catalogs.water(l.select("i").distinct(), l.where("i >= 100"), ["i"])
