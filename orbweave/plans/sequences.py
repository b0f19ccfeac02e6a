"""Window and sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbweave.operators import catalog, digest, events, tracking
from orbweave.operators.windows import anchored_groups, local_minima, with_rest
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql

_SERIES = """c AS (SELECT site, CASE cls WHEN 'storage-tank' THEN 'tank' ELSE cls END AS family, source, scene_id, count(*) AS n, min(time) AS time FROM obs GROUP BY 1, 2, 3, 4),
h AS (SELECT *, list(CAST(n AS DOUBLE)) OVER (PARTITION BY site, family, source ORDER BY time, scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM c),
m AS (SELECT *, list_median(l) AS median FROM h WHERE len(l) >= 4),
z AS (SELECT *, (n - median) / (list_median(list_transform(l, lambda x: abs(x - median))) * CAST(1.4826 AS DOUBLE) + sqrt(greatest(median, 1))) AS z FROM m)"""


@R.add("w1_prefix_robust_z", f"WITH {_SERIES} SELECT site, family, source, scene_id, n, median, round(z, 6) AS z FROM z")
def w1(spark, d):
    from orbweave.functions import domain
    from orbweave.operators.windows import prefix_robust_z

    o = fx.observations(spark, d)
    c = o.groupBy("site", domain.family(F.col("cls")).alias("family"), "source", "scene_id").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("time"))
    return prefix_robust_z(c, ["site", "family", "source"], ["time", "scene_id"], "n").select("site", "family", "source", "scene_id", "n", "median", F.round("z", 6).alias("z"))


@R.add("e7_count_anomalies", f"WITH {_SERIES} SELECT substr(sha1(concat_ws('|', CASE WHEN z > 0 THEN 'count_spike' ELSE 'count_drop' END, site, family, scene_id)), 1, 16) AS event_id, site, family, source, scene_id, CASE WHEN z > 0 THEN 'count_spike' ELSE 'count_drop' END AS kind, n, median, round(z, 1) AS z, round(least(1.0, 0.3 + abs(z) / 10), 2) AS severity FROM z WHERE abs(z) >= 3")
def e7(spark, d):
    return events.count_anomalies(fx.observations(spark, d))


@R.add("w2_step_speed", "WITH t AS (SELECT track_id, obs_id, lat, lon, epoch_us(time) / 1e6 AS t, lag(lat) OVER w AS a, lag(lon) OVER w AS o, lag(epoch_us(time) / 1e6) OVER w AS p FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY time, obs_id)) SELECT track_id, obs_id, round(m, 2) AS metres, round(m / (t - p), 6) AS speed FROM (SELECT *, sqrt(pow((lon - o) * 111320.0::DOUBLE * cos(radians((lat + a) / 2)), 2) + pow((lat - a) * 110574.0::DOUBLE, 2)) AS m FROM t) WHERE t - p > 0 AND t - p <= 259200")
def w2(spark, d):
    from orbweave.functions import geo

    w = Window.partitionBy("track_id").orderBy("time", "obs_id")
    t = F.unix_micros(F.col("time").cast("timestamp")) / F.lit(1e6)
    o = fx.observations(spark, d)
    rows = o.select("track_id", "obs_id", geo.distance_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")).alias("m"), (t - F.lag(t).over(w)).alias("dt"))
    return rows.where((F.col("dt") > 0) & (F.col("dt") <= tracking.VELOCITY_SPAN_S)).select("track_id", "obs_id", F.round("m", 2).alias("metres"), F.round(F.col("m") / F.col("dt"), 6).alias("speed"))


@R.add("w4_last_looks", "WITH t AS (SELECT scene_id, site, row_number() OVER (PARTITION BY site ORDER BY time, scene_id) - 1 AS look, count(*) OVER (PARTITION BY site) AS looks FROM scenes WHERE coalesce(clear, 1.0) >= 0.85) SELECT scene_id, look, looks FROM t WHERE looks > 6 AND look >= greatest(6, looks - 3)", "scenes")
def w4(spark, d):
    s = fx.scenes(spark, d).where(events.clear_look(F.col("clear")))
    w = Window.partitionBy("site")
    t = s.select("scene_id", (F.row_number().over(w.orderBy("time", "scene_id")) - 1).cast("long").alias("look"), F.count(F.lit(1)).over(w).alias("looks"))
    return t.where((F.col("looks") > 6) & (F.col("look") >= F.greatest(F.lit(6), F.col("looks") - 3)))


@R.add("w5_longest_per_scene", "WITH t AS (SELECT scene_id, obs_id, row_number() OVER (PARTITION BY scene_id ORDER BY length_m DESC, obs_id) AS place, count(*) OVER (PARTITION BY scene_id) AS n FROM obs WHERE cls = 'vessel') SELECT scene_id, obs_id, place, n FROM t WHERE place <= 4")
def w5(spark, d):
    o = fx.observations(spark, d).where("cls = 'vessel'")
    return with_rest(o, ["scene_id"], [F.col("length_m").desc(), F.col("obs_id")], 4).select("scene_id", "obs_id", F.col("place").cast("long").alias("place"), F.col("group_size").alias("n"))


for _every, _form in {"week": "%G-W%V", "month": "%Y-%m", "day": "%Y-%m-%d"}.items():

    @R.add(f"w6_frames_{_every}", f"WITH t AS (SELECT scene_id, strftime(time, '{_form}') AS period, row_number() OVER (PARTITION BY strftime(time, '{_form}') ORDER BY coalesce(cloud, 0), gsd, time, scene_id) AS k FROM scenes) SELECT period, scene_id FROM t WHERE k = 1", "scenes")
    def frames(spark, d, every=_every):
        return catalog.pick_frames(fx.scenes(spark, d).withColumn("coverage", F.lit(1.0)), every).select("period", "scene_id")


_GROUPS = """o AS (SELECT site, source, epoch_us(time) / 1e6 AS t, row_number() OVER (PARTITION BY site, source ORDER BY time, obs_id) AS k FROM obs),
g AS (SELECT site, source, k, t, t AS start FROM o WHERE k = 1 UNION ALL SELECT o.site, o.source, o.k, o.t, CASE WHEN o.t - g.start > 21600 THEN o.t ELSE g.start END FROM g JOIN o ON o.site = g.site AND o.source = g.source AND o.k = g.k + 1)"""


@R.add("w7_anchored_groups", f"WITH {_GROUPS} SELECT site, source, start AS group_start, count(*) AS n FROM g GROUP BY 1, 2, 3", recursive=True)
def w7(spark, d):
    o = fx.observations(spark, d).withColumn("t", F.unix_micros(F.col("time").cast("timestamp")) / F.lit(1e6))
    return anchored_groups(o, ["site", "source"], "t", 21600.0)


@R.add("w8_merge_passes", "WITH o AS (SELECT *, concat('S', site) AS platform, epoch_us(time) / 1e6 AS t, round((10 - gsd % 7) / 10, 3) AS coverage, row_number() OVER (PARTITION BY source, site ORDER BY time, scene_id) AS k FROM scenes), g AS (SELECT source, platform, k, t, t AS start FROM o WHERE k = 1 UNION ALL SELECT o.source, o.platform, o.k, o.t, CASE WHEN o.t - g.start > 259200 THEN o.t ELSE g.start END FROM g JOIN o ON o.source = g.source AND o.platform = g.platform AND o.k = g.k + 1), j AS (SELECT o.*, g.start FROM o JOIN g ON o.source = g.source AND o.platform = g.platform AND o.k = g.k) SELECT source, platform, first(scene_id ORDER BY coverage DESC, t, scene_id) AS scene_id, count(*) AS n, min(w) AS w, max(n_lat) AS n_lat FROM j GROUP BY source, platform, start", "scenes", recursive=True)
def w8(spark, d):
    s = fx.scenes(spark, d).withColumn("platform", F.concat(F.lit("S"), "site")).withColumn("coverage", F.round((F.lit(10) - F.col("gsd") % 7) / 10, 3))
    return catalog.merge_passes(s, 259200.0).select("source", "platform", "scene_id", F.col("n").cast("long").alias("n"), "w", "n_lat")


@R.add("w9_local_minima", "WITH t AS (SELECT site, scene_id, n, lag(n) OVER w AS p, lead(n) OVER w AS x FROM scenes WINDOW w AS (PARTITION BY site ORDER BY time)) SELECT site, scene_id, n FROM t WHERE n < p AND n <= x AND n < 800", "scenes")
def w9(spark, d):
    return local_minima(fx.scenes(spark, d), ["site"], "time", "n", 800.0).select("site", "scene_id", "n")


@R.add("w12_notable_tracks", "WITH s AS (SELECT site, track_id, arg_max(cls, (time, obs_id)) AS cls, max(length_m) AS length_m, count(*) AS n_obs FROM obs GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY length_m DESC, n_obs DESC, track_id) AS place FROM s WHERE cls IN ('vessel', 'aircraft')) SELECT site, track_id, place FROM t WHERE place <= 6")
def w12(spark, d):
    s = tracking.track_summary(fx.observations(spark, d), ["site", "track_id"])
    return digest.notable(s).select("site", "track_id", F.col("place").cast("long").alias("place"))


@R.add("w13_evidence_numbers", "SELECT concat('E', CAST(row_number() OVER (ORDER BY time, obs_id) AS VARCHAR)) AS evidence, obs_id FROM obs WHERE site = 'S2' AND cls = 'aircraft'")
def w13(spark, d):
    o = fx.observations(spark, d).where("site = 'S2' and cls = 'aircraft'")
    return o.select(F.concat(F.lit("E"), F.row_number().over(Window.orderBy("time", "obs_id")).cast("string")).alias("evidence"), "obs_id")


@R.add("a11_track_summary", "WITH t AS (SELECT *, sqrt(pow((lon - lag(lon) OVER w) * 111320.0::DOUBLE * cos(radians((lat + lag(lat) OVER w) / 2)), 2) + pow((lat - lag(lat) OVER w) * 110574.0::DOUBLE, 2)) AS step, epoch_us(time) / 1e6 - lag(epoch_us(time) / 1e6) OVER w AS gap FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY time, obs_id)) SELECT track_id, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n_obs, round(median(length_m), 1) AS length_m, round(median(CASE WHEN gap > 0 AND gap <= 259200 THEN step / gap END), 4) AS speed_ms, round(coalesce(sum(step), 0), 1) AS distance_m, round((epoch_us(max(time)) / 1e6 - epoch_us(min(time)) / 1e6) / 86400, 2) AS dwell_days, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM t GROUP BY track_id")
def a11(spark, d):
    from orbweave.functions import geo

    o = fx.observations(spark, d)
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    w = Window.partitionBy("track_id").orderBy("time", "obs_id")
    gap = (F.unix_micros(F.col("time").cast("timestamp")) - F.lag(F.unix_micros(F.col("time").cast("timestamp"))).over(w)) / F.lit(1e6)
    step = geo.distance_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    fine = o.select("track_id", F.when((gap > 0) & (gap <= tracking.VELOCITY_SPAN_S), step / gap).alias("v")).groupBy("track_id").agg(F.round(F.median("v"), 4).alias("speed"))
    s = tracking.track_summary(o, ["track_id"]).join(fine, "track_id")
    return s.select("track_id", t("first_seen"), t("last_seen"), "n_obs", "length_m", F.col("speed").alias("speed_ms"), "distance_m", "dwell_days", F.array_join("sources", ",").alias("sources"))
