"""Aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import domain
from orbweave.operators import catalog, desk, digest
from orbweave.operators.windows import first_per_group
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql
def count_rows():
    return F.count(F.lit(1)).alias("n")


@R.add("a1_count_by_class", "SELECT cls, count(*) AS n FROM obs GROUP BY cls")
def a1(spark, d):
    return fx.observations(spark, d).groupBy("cls").agg(count_rows())


@R.add("a2_count_by_site", "SELECT site, count(*) AS n FROM obs GROUP BY site")
def a2(spark, d):
    return fx.observations(spark, d).groupBy("site").agg(count_rows())


@R.add("a3_count_by_scene_class", "SELECT scene_id, cls, count(*) AS n FROM obs GROUP BY 1, 2")
def a3(spark, d):
    return fx.observations(spark, d).groupBy("scene_id", "cls").agg(count_rows())


@R.add("a4_ships_rollup", "SELECT mmsi, count(*) AS n, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last_seen, round(avg(sog), 6) AS sog, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, min(length_m) AS length_m FROM ais GROUP BY mmsi ORDER BY n DESC, mmsi LIMIT 60", "ais")
def a4(spark, d):
    t = lambda f, name: F.date_format(f("time"), "yyyy-MM-dd HH:mm:ss").alias(name)
    return fx.positions(spark, d).groupBy("mmsi").agg(
        count_rows(), t(F.min, "first_seen"), t(F.max, "last_seen"), *[F.round(F.avg(c), 6).alias(c) for c in ("sog", "lat", "lon")], F.min("length_m").alias("length_m")
    ).orderBy(F.col("n").desc(), "mmsi").limit(60)


@R.add("a5_daily_class_pivot", "SELECT strftime(time, '%Y-%m-%d') AS day, source, count(*) FILTER (cls = 'vessel') AS vessel, count(*) FILTER (cls = 'aircraft') AS aircraft, count(*) FILTER (cls = 'vehicle') AS vehicle, count(*) FILTER (cls = 'storage-tank') AS tank, count(*) AS total FROM obs GROUP BY 1, 2")
def a5(spark, d):
    o = fx.observations(spark, d)
    of = lambda c, name: F.count_if(F.col("cls") == c).alias(name)
    return o.groupBy(F.date_format("time", "yyyy-MM-dd").alias("day"), "source").agg(of("vessel", "vessel"), of("aircraft", "aircraft"), of("vehicle", "vehicle"), of("storage-tank", "tank"), F.count(F.lit(1)).alias("total"))


@R.add("a6_max_severity", "SELECT site, max(CASE WHEN cls = 'vessel' THEN CASE WHEN length_m >= 250 THEN 0.85 WHEN length_m >= 150 THEN 0.6 WHEN length_m >= 80 THEN 0.45 ELSE 0.25 END WHEN cls = 'aircraft' THEN 0.6 ELSE 0.2 END)::DOUBLE AS severity FROM obs WHERE time >= TIMESTAMP '2024-01-10' GROUP BY site")
def a6(spark, d):
    o = fx.observations(spark, d).where(F.col("time") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return o.groupBy("site").agg(F.max(domain.object_severity(F.col("cls"), F.col("length_m"))).cast("double").alias("severity"))


@R.add("a7_length_histogram", "SELECT site, CASE WHEN length_m < 50 THEN '<50' WHEN length_m < 100 THEN '50-100' WHEN length_m < 200 THEN '100-200' WHEN length_m < 300 THEN '200-300' ELSE '>=300' END AS bin, count(*) AS n FROM obs GROUP BY 1, 2")
def a7(spark, d):
    return digest.length_histogram(fx.observations(spark, d), ["site"])


@R.add("a8_conditional_counts", "SELECT scene_id, count(*) FILTER (underway) AS moving, count(*) FILTER (length_m >= 200) AS large FROM obs GROUP BY scene_id")
def a8(spark, d):
    return fx.observations(spark, d).groupBy("scene_id").agg(F.count_if("underway").alias("moving"), F.count_if(F.col("length_m") >= 200).alias("large"))


@R.add("a9_median_length", "SELECT site, cls, median(length_m) AS length_m FROM obs GROUP BY 1, 2")
def a9(spark, d):
    return fx.observations(spark, d).groupBy("site", "cls").agg(F.median("length_m").alias("length_m"))


@R.add("a10_robust_spread", "WITH m AS (SELECT site, median(length_m) AS med FROM obs GROUP BY site) SELECT m.site, med, round(median(abs(length_m - med)) * 1.4826, 6) AS mad FROM obs JOIN m ON obs.site = m.site GROUP BY m.site, med")
def a10(spark, d):
    o = fx.observations(spark, d)
    m = o.groupBy("site").agg(F.median("length_m").alias("med"))
    return o.join(m, "site").groupBy("site", "med").agg(F.round(F.median(F.abs(F.col("length_m") - F.col("med"))) * 1.4826, 6).alias("mad"))


@R.add("a12_crowded_sites", "WITH c AS (SELECT site, scene_id, count(*) AS n FROM obs WHERE cls = 'vessel' GROUP BY 1, 2) SELECT site, median(n) AS per_scene, median(n) > 12 AS crowded FROM c GROUP BY site")
def a12(spark, d):
    c = fx.observations(spark, d).where("cls = 'vessel'").groupBy("site", "scene_id").agg(count_rows())
    return c.groupBy("site").agg(F.median("n").alias("per_scene"), (F.median("n") > 12).alias("crowded"))


@R.add("a13_clear_baseline", "SELECT o.site, CASE o.cls WHEN 'storage-tank' THEN 'tank' ELSE o.cls END AS family, strftime(min(o.time), '%Y-%m-%d %H:%M:%S') AS first_seen FROM obs o JOIN scenes s ON o.scene_id = s.scene_id WHERE coalesce(s.clear, 1.0) >= 0.85 GROUP BY 1, 2", "scenes")
def a13(spark, d):
    from orbweave.operators.events import clear_look

    o = fx.observations(spark, d).join(fx.scenes(spark, d).where(clear_look(F.col("clear"))).select("scene_id"), "scene_id", "left_semi")
    return o.groupBy("site", domain.family(F.col("cls")).alias("family")).agg(F.date_format(F.min("time"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@R.add("a14_pairs_seen_together", "SELECT least(a.track_id, b.track_id) AS a, greatest(a.track_id, b.track_id) AS b, count(DISTINCT a.scene_id) AS scenes FROM obs a JOIN obs b ON a.scene_id = b.scene_id AND a.obs_id < b.obs_id AND a.track_id <> b.track_id WHERE a.cls = 'aircraft' AND b.cls = 'aircraft' GROUP BY 1, 2")
def a14(spark, d):
    o = fx.observations(spark, d).where("cls = 'aircraft'").select("scene_id", "track_id").distinct()
    return desk.pairs_seen_together(o).select("a", "b", F.col("scenes_together").alias("scenes"))


@R.add("a17_union_coverage", "WITH g AS (SELECT CAST(56.0 AS DOUBLE) + (i % 24 + CAST(0.5 AS DOUBLE)) * CAST(0.2 AS DOUBLE) / 24 AS x, CAST(26.0 AS DOUBLE) + (i // 24 + CAST(0.5 AS DOUBLE)) * CAST(0.2 AS DOUBLE) / 24 AS y FROM range(576) t(i)) SELECT site, count(DISTINCT (x, y)) / CAST(576 AS DOUBLE) AS coverage FROM scenes JOIN g ON x BETWEEN w AND e AND y BETWEEN s AND n_lat GROUP BY site", "scenes")
def a17(spark, d):
    return catalog.union_coverage(fx.scenes(spark, d), ["site"], (56.0, 26.0, 56.2, 26.2))


@R.add("a18_activity_series", "WITH k AS (SELECT DISTINCT site, cls FROM obs), c AS (SELECT scene_id, cls, count(*) AS n FROM obs GROUP BY 1, 2) SELECT s.scene_id, k.cls, coalesce(c.n, 0) AS n FROM scenes s JOIN k ON s.site = k.site LEFT JOIN c ON c.scene_id = s.scene_id AND c.cls = k.cls", "scenes")
def a18(spark, d):
    return digest.series(fx.observations(spark, d), fx.scenes(spark, d)).select("scene_id", "cls", "n")


@R.add("a19_digest_counts", "WITH k AS (SELECT DISTINCT site, cls FROM obs), c AS (SELECT scene_id, cls, count(*) AS n FROM obs GROUP BY 1, 2), t AS (SELECT s.site, k.cls, s.time, s.scene_id, coalesce(c.n, 0) AS n FROM scenes s JOIN k ON s.site = k.site LEFT JOIN c ON c.scene_id = s.scene_id AND c.cls = k.cls WHERE coalesce(nullif(s.clear, 0), 1.0) >= 0.85) SELECT site, cls, median(n) FILTER (time < TIMESTAMP '2024-01-15') AS baseline_median, median(n) FILTER (time >= TIMESTAMP '2024-01-15') AS period_median, arg_max(n, time) AS latest FROM t GROUP BY 1, 2", "scenes")
def a19(spark, d):
    return digest.class_counts(fx.observations(spark, d), fx.scenes(spark, d), F.lit("2024-01-15").cast("date"))


@R.add("a21_stretch", "SELECT site, round(quantile_cont(value, 0.02), 6) AS lo, round(quantile_cont(value, 0.995), 6) AS hi, round(avg(value), 6) AS mean FROM obs GROUP BY site")
def a21(spark, d):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return fx.observations(spark, d).groupBy("site").agg(p(0.02).alias("lo"), p(0.995).alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@R.add("a24_class_listing", "WITH c AS (SELECT site, cls, count(*) AS n FROM obs GROUP BY 1, 2) SELECT site, string_agg(concat(CAST(n AS VARCHAR), ' ', cls), ', ' ORDER BY n DESC, cls) AS listing FROM c GROUP BY site")
def a24(spark, d):
    c = fx.observations(spark, d).groupBy("site", "cls").agg(count_rows())
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "cls")))
    text = F.transform(items, lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), x["cls"]))
    return c.groupBy("site").agg(F.array_join(text, ", ").alias("listing"))


@R.add("a25_newest_per_source", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY site, source ORDER BY time DESC, obs_id) AS k FROM obs) SELECT site, source, obs_id FROM t WHERE k = 1")
def a25(spark, d):
    return first_per_group(fx.observations(spark, d), ["site", "source"], [F.col("time").desc(), F.col("obs_id")]).select("site", "source", "obs_id")


for _name, _order in {
    "best": "round_even(log2(greatest(gsd, 0.05)), 0), coverage < 0.5, coalesce(cloud, 0) > 50, time DESC",
    "date": "time DESC",
    "resolution": "gsd, time DESC",
    "cloud": "coalesce(cloud, 0), gsd, time DESC",
}.items():
    _sql = f"WITH c AS (SELECT *, round(CASE WHEN dx <= 0 OR dy <= 0 THEN 0 ELSE dx * dy / (CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE)) END, 3) AS coverage FROM (SELECT *, least(CAST(56.15 AS DOUBLE), e) - greatest(CAST(56.05 AS DOUBLE), w) AS dx, least(CAST(26.15 AS DOUBLE), n_lat) - greatest(CAST(26.05 AS DOUBLE), s) AS dy FROM scenes)) SELECT row_number() OVER (ORDER BY {_order}, scene_id) AS place, scene_id, coverage FROM c WHERE coverage > 0 ORDER BY place LIMIT 40"

    @R.add(f"o1_rank_{_name}", _sql, "scenes")
    def rank(spark, d, sort=_name):
        found = catalog.search([fx.scenes(spark, d)], (56.05, 26.05, 56.15, 26.15)).orderBy(*catalog.order_of(sort)).limit(40)
        from pyspark.sql import Window

        return found.withColumn("place", F.row_number().over(Window.orderBy(*catalog.order_of(sort)))).select("place", "scene_id", "coverage")


@R.add("o3_events_top", "SELECT obs_id, round(value, 6) AS severity FROM obs ORDER BY value DESC, time DESC, obs_id LIMIT 25")
def o3(spark, d):
    return fx.observations(spark, d).orderBy(F.col("value").desc(), F.col("time").desc(), "obs_id").limit(25).select("obs_id", F.round("value", 6).alias("severity"))


@R.add("o6_class_priority", "SELECT obs_id, cls FROM obs ORDER BY CASE cls WHEN 'aircraft' THEN 0 WHEN 'vessel' THEN 2 WHEN 'vehicle' THEN 3 ELSE 9 END, value DESC, obs_id LIMIT 100")
def o6(spark, d):
    order = F.when(F.col("cls") == "aircraft", 0).when(F.col("cls") == "vessel", 2).when(F.col("cls") == "vehicle", 3).otherwise(9)
    return fx.observations(spark, d).orderBy(order, F.col("value").desc(), "obs_id").limit(100).select("obs_id", "cls")


@R.add("o9_tracks_top", "SELECT track_id, count(*) AS n_obs, max(length_m) AS length_m FROM obs GROUP BY 1 ORDER BY n_obs DESC, length_m DESC, track_id LIMIT 30")
def o9(spark, d):
    t = fx.observations(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_obs"), F.max("length_m").alias("length_m"))
    return t.orderBy(F.col("n_obs").desc(), F.col("length_m").desc(), "track_id").limit(30)


@R.add("u1_union_sources", "SELECT obs_id AS id, 'detection' AS kind, lat, lon FROM obs UNION ALL SELECT mmsi, 'report', lat, lon FROM ais", "obs ais")
def u1(spark, d):
    o = fx.observations(spark, d).select(F.col("obs_id").alias("id"), F.lit("detection").alias("kind"), "lat", "lon")
    return o.unionByName(fx.positions(spark, d).select(F.col("mmsi").alias("id"), F.lit("report").alias("kind"), "lat", "lon"))


@R.add("u7_exclude_own_region", "SELECT track_id, count(*) AS n FROM obs WHERE track_id NOT IN (SELECT track_id FROM obs WHERE length_m >= 300) GROUP BY track_id")
def u7(spark, d):
    o = fx.observations(spark, d)
    return o.join(o.where("length_m >= 300").select("track_id"), "track_id", "left_anti").groupBy("track_id").agg(count_rows())


@R.add("x_cube_counts", "SELECT site, cls, count(*) AS n, CAST(grouping(site, cls) AS BIGINT) AS g FROM obs GROUP BY CUBE (site, cls)")
def cube(spark, d):
    """Extension: grouping sets, which the surveyed engine has not."""
    return fx.observations(spark, d).cube("site", "cls").agg(count_rows(), F.grouping_id("site", "cls").alias("g"))


@R.add("x_hourly_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, time), '%Y-%m-%d %H:%M:%S') AS start, cls, count(*) AS n FROM obs GROUP BY 1, 2")
def windows(spark, d):
    """Extension: tumbling windows."""
    from orbweave.streaming.sweep import windowed_counts

    o = fx.observations(spark, d).withColumn("time", F.col("time").cast("timestamp"))
    return windowed_counts(o, "time", ["cls"], "6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
