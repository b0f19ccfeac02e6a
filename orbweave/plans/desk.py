"""Queries of the analyst's desk."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import text
from orbweave.operators import desk
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql
BOX = (56.05, 26.02, 56.15, 26.12)
_IN = "lon BETWEEN 56.05 AND 56.15 AND lat BETWEEN 26.02 AND 26.12"
_MINUTE = "yyyy-MM-dd HH:mm"


@R.add("sc3_track_scan", f"SELECT site, track_id, status, n_obs, strftime(last_seen, '%Y-%m-%d %H:%M') AS last_seen FROM tracks WHERE status = 'active' AND {_IN} ORDER BY tracks.last_seen DESC, site, track_id LIMIT 20000", "tracks")
def sc3(spark, d):
    t = desk.scan_tracks(fx.tracks(spark, d), status="active", box=BOX)
    return t.select("site", "track_id", "status", "n_obs", F.date_format("last_seen", _MINUTE).alias("last_seen"))


@R.add("k7_get_tracks", f"WITH m AS (SELECT *, count(*) OVER () AS total FROM tracks WHERE n_obs >= 2 AND cls = 'vessel' AND {_IN}) SELECT site, track_id, n_obs, length_m, status, total FROM m ORDER BY n_obs DESC, length_m DESC, site, track_id LIMIT 15", "tracks")
def k7(spark, d):
    return desk.get_tracks(fx.tracks(spark, d), BOX, cls="vessel").select("site", "track_id", "n_obs", "length_m", "status", "total")


@R.add("k8_get_track", "WITH own AS (SELECT obs_id, prob FROM links WHERE track_id = 'T7' AND site = 'S2' AND chosen = 1), r AS (SELECT obs_id, string_agg(concat(track_id, ':', printf('%.2f', prob)), ' ' ORDER BY prob DESC, track_id) AS rivals FROM links WHERE chosen = 0 AND track_id <> 'T7' AND obs_id IN (SELECT obs_id FROM own) GROUP BY obs_id) SELECT o.obs_id, strftime(o.time, '%Y-%m-%d %H:%M') AS seen, o.source, own.prob, coalesce(r.rivals, '') AS rivals FROM obs o JOIN own ON o.obs_id = own.obs_id LEFT JOIN r ON r.obs_id = o.obs_id", "links")
def k8(spark, d):
    t = desk.track_detail(fx.observations(spark, d), fx.links(spark, d), "T7", "S2")
    return t.select("obs_id", F.date_format("time", _MINUTE).alias("seen"), "source", "prob", "rivals")


@R.add("sc7_event_scan", "SELECT event_id, kind, severity FROM ev WHERE time >= TIMESTAMP '2024-01-10' AND site = 'S1' ORDER BY severity DESC, time DESC, event_id LIMIT 500", "ev")
def sc7(spark, d):
    return desk.scan_events(fx.site_events(spark, d), "2024-01-10", "S1").select("event_id", "kind", "severity")


@R.add("k9_get_events", f"SELECT v.event_id, v.kind, v.severity, concat('length_m=', CAST(CAST(v.length_m AS INTEGER) AS VARCHAR), ',z=', CAST(v.event_id % 9 AS VARCHAR)) AS detail FROM ev v LEFT JOIN sites s ON v.site = s.site WHERE severity >= 0.5 AND v.time >= TIMESTAMP '2024-01-05' AND (v.kind LIKE 'change_%' OR v.kind LIKE 'dark%') AND (({_IN}) OR NOT coalesce(s.e < 56.05 OR 56.15 < s.w OR s.n < 26.02 OR 26.12 < s.s, true)) ORDER BY severity DESC, v.time DESC, event_id LIMIT 500", "ev sites")
def k9(spark, d):
    e = desk.scan_events(fx.site_events(spark, d), "2024-01-05", kinds=["change_", "dark"], least=0.5, box=BOX, sites=fx.sites(spark, d))
    listed = F.transform(F.array_sort(F.map_entries(desk.without_keys(F.col("detail")))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.select("event_id", "kind", "severity", F.array_join(listed, ",").alias("detail"))


@R.add("pf16_digest_keys", "SELECT event_id, concat('length_m=', CAST(CAST(length_m AS INTEGER) AS VARCHAR), ',z=', CAST(event_id % 9 AS VARCHAR)) AS detail FROM ev WHERE site = 'S3'", "ev")
def pf16(spark, d):
    kept = F.map_filter(desk.only_keys(F.col("detail")), lambda k, v: k != "lat")
    listed = F.transform(F.array_sort(F.map_entries(kept)), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return fx.site_events(spark, d).where("site = 'S3'").select("event_id", F.array_join(listed, ",").alias("detail"))


_SHARE = "CASE WHEN dx <= 0 OR dy <= 0 THEN 0 ELSE dx * dy / (CAST(56.15 AS DOUBLE) - CAST(56.05 AS DOUBLE)) / (CAST(26.12 AS DOUBLE) - CAST(26.02 AS DOUBLE)) END"
_SEARCH = f"""g AS (SELECT *, least(CAST(56.15 AS DOUBLE), e) - greatest(CAST(56.05 AS DOUBLE), w) AS dx, least(CAST(26.12 AS DOUBLE), n_lat) - greatest(CAST(26.02 AS DOUBLE), s) AS dy FROM scenes
 WHERE time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' AND coalesce(cloud, 0) <= 70),
i AS (SELECT scene_id, source, time, sensor, gsd, round({_SHARE}, 3) AS coverage FROM g), t AS (SELECT * FROM i WHERE coverage >= 0.3 ORDER BY time DESC, scene_id LIMIT 40)"""


def _images(spark, d):
    return desk.image_search(fx.scenes(spark, d), BOX, "2024-01-03", "2024-01-28", 70.0)


@R.add("k2_search_imagery", f"WITH {_SEARCH} SELECT scene_id, source, sensor, gsd, coverage FROM t", "scenes")
def k2(spark, d):
    return _images(spark, d).select("scene_id", "source", "sensor", "gsd", "coverage")


@R.add("k2_image_summary", f"WITH {_SEARCH} SELECT source, count(*) AS n, strftime(max(time), '%Y-%m-%d') AS newest FROM t GROUP BY source", "scenes")
def k2b(spark, d):
    return desk.image_summary(_images(spark, d))


@R.add("k11_wayback_history", "WITH r AS (SELECT scene_id AS release, strftime(time, '%Y-%m-%d') AS release_date, CASE WHEN cloud IS NULL THEN NULL ELSE CAST(CAST(cloud AS BIGINT) // 10 AS VARCHAR) END AS captured, sensor, CAST(CAST(gsd * 10 AS INTEGER) AS VARCHAR) AS resolution FROM scenes), k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN captured IS NULL THEN release ELSE concat(captured, '|', sensor, '|', resolution) END ORDER BY release_date DESC, release DESC) AS k FROM r) SELECT release, captured, sensor, resolution FROM k WHERE k = 1 ORDER BY release_date DESC, release DESC LIMIT 30", "scenes")
def k11(spark, d):
    r = fx.scenes(spark, d).select(
        F.col("scene_id").alias("release"), F.date_format("time", "yyyy-MM-dd").alias("release_date"), F.floor(F.col("cloud") / 10).cast("string").alias("captured"), "sensor",
        (F.col("gsd") * 10).cast("int").cast("string").alias("resolution"),
    )
    return desk.captures(r).select("release", "captured", "sensor", "resolution")


@R.add("k12_list_sites", "SELECT s.site, s.kind, coalesce(c.n, 0) AS observations, coalesce(m.top, 0) AS max_severity FROM sites s LEFT JOIN (SELECT site, count(*) AS n FROM obs GROUP BY 1) c ON c.site = s.site LEFT JOIN (SELECT site, max(severity) AS top FROM ev WHERE time >= TIMESTAMP '2024-01-20' GROUP BY 1) m ON m.site = s.site", "ev sites")
def k12(spark, d):
    return desk.list_sites(fx.sites(spark, d), fx.observations(spark, d), fx.site_events(spark, d), "2024-01-20").select("site", "kind", "observations", "max_severity")


def _runs(spark, d):
    s = fx.scenes(spark, d)
    day = F.dayofmonth("time")
    return s.select("site", "scene_id", F.lit("ships").alias("detector"), F.when(day % 3 == 0, "error").otherwise("ok").alias("status"), day.cast("long").alias("finished"))


_RUNS = "runs AS (SELECT site, scene_id, 'ships' AS detector, CASE WHEN extract(day FROM time) % 3 = 0 THEN 'error' ELSE 'ok' END AS status, extract(day FROM time) AS finished FROM scenes)"


@R.add("sk9_run_guard", f"WITH {_RUNS} SELECT site, scene_id FROM scenes WHERE extract(day FROM time) > 10 EXCEPT SELECT site, scene_id FROM runs WHERE status = 'ok' AND finished <= 20", "scenes")
def sk9(spark, d):
    wanted = fx.scenes(spark, d).where(F.dayofmonth("time") > 10).select("site", "scene_id", F.lit("ships").alias("detector"))
    return desk.unprocessed(wanted, _runs(spark, d).where("finished <= 20")).select("site", "scene_id")


@R.add("sk10_record_runs", f"WITH {_RUNS} SELECT scene_id, CASE WHEN finished % 2 = 0 THEN 'again' ELSE status END AS status FROM runs", "scenes")
def sk10(spark, d):
    r = _runs(spark, d)
    again = r.where("finished % 2 = 0").withColumn("status", F.lit("again")).withColumn("finished", F.col("finished") + 100)
    return desk.record_runs(r, again).select("scene_id", "status")


@R.add("sk8_delete_site", "SELECT site, title FROM sites WHERE site <> 'S3'", "sites")
def sk8(spark, d):
    left, _ = desk.delete_site(fx.sites(spark, d), "S3")
    return left.select("site", "title")


@R.add("sk11_add_events", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN severity WHEN event_id % 3 = 0 THEN 0.5 ELSE severity END AS severity, event_id % 4 <> 0 AS is_new FROM ev WHERE event_id % 4 = 0 OR event_id % 2 = 0", "ev")
def sk11(spark, d):
    e = fx.site_events(spark, d).select("event_id", "severity")
    new = e.where("event_id % 2 = 0").withColumn("severity", F.when(F.col("event_id") % 3 != 0, F.col("severity")))
    whole, fresh = desk.add_events(e.where("event_id % 4 = 0"), new)
    return whole.join(fresh.select("event_id", F.lit(True).alias("is_new")), "event_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


@R.add("sk5_links", "SELECT track_id, count(*) FILTER (chosen = 1) AS chosen, count(*) FILTER (chosen = 0) AS rivals FROM links GROUP BY track_id", "links")
def sk5(spark, d):
    return fx.links(spark, d).groupBy("track_id").agg(F.count_if(F.col("chosen") == 1).alias("chosen"), F.count_if(F.col("chosen") == 0).alias("rivals"))


@R.add("sk6_replace_links", "SELECT site, chosen, count(*) AS n FROM (SELECT site, chosen FROM links WHERE site NOT IN ('S1', 'S2') UNION ALL SELECT site, chosen FROM links WHERE site IN ('S1', 'S2') AND prob >= 0.5) GROUP BY 1, 2", "links")
def sk6(spark, d):
    l = fx.links(spark, d)
    return desk.save_tracking(l, l.where("site in ('S1', 'S2') and prob >= 0.5"), ["S1", "S2"]).groupBy("site", "chosen").agg(F.count(F.lit(1)).alias("n"))


@R.add("sc8_investigations", "SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN '{\"turns\":' || CAST(count(*) AS VARCHAR) || '}' ELSE '{\"turns\":0}' END AS body FROM conversations GROUP BY conv_id ORDER BY max(turn) + CASE WHEN conv_id % 2 = 0 THEN 100 ELSE 0 END DESC, conv_id LIMIT 20", "")
def sc8(spark, d):
    c = fx.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("started"), F.count(F.lit(1)).alias("turns"))
    old = c.select("id", F.lit("q").alias("question"), "started", F.lit('{"turns":0}').alias("body"))
    new = c.where("id % 2 = 0").select("id", F.lit("q").alias("question"), (F.col("started") + 100).alias("started"), "turns")
    return desk.investigations(desk.save_investigations(old, new)).select("id", "body")


@R.add("j17_pairs_with_counts", "WITH p AS (SELECT DISTINCT a.track_id AS a, b.track_id AS b, a.scene_id FROM obs a JOIN obs b ON a.scene_id = b.scene_id AND a.cls = 'aircraft' AND b.cls = 'vehicle'), c AS (SELECT least(a, b) AS l, greatest(a, b) AS h, count(DISTINCT scene_id) AS n FROM p GROUP BY 1, 2) SELECT a, b, scene_id, n AS scenes_together FROM p JOIN c ON l = least(a, b) AND h = greatest(a, b)")
def j17(spark, d):
    o = fx.observations(spark, d)
    seen = lambda cls: o.where(F.col("cls") == cls).select("scene_id", "track_id").distinct()
    return desk.pairs_seen_together(seen("aircraft"), seen("vehicle"))


@R.add("j18_events_with_sightings", "SELECT v.event_id, o.source, o.length_m FROM ev v JOIN obs o ON o.obs_id = v.event_id WHERE v.severity >= 0.9", "ev")
def j18(spark, d):
    e = fx.site_events(spark, d).where("severity >= 0.9").select("event_id")
    return e.join(fx.observations(spark, d).select(F.col("obs_id").alias("event_id"), "source", "length_m"), "event_id")


@R.add("a20_citation_report", """WITH a AS (SELECT doc_id AS id, concat('see [E', CAST(doc_id % 5 AS VARCHAR), '] and [E2, E', CAST(doc_id % 9 AS VARCHAR), ']') AS t FROM documents),
c AS (SELECT id, list_transform([id % 5, 2, id % 9], lambda x: concat('E', CAST(x AS VARCHAR))) AS l FROM a), x AS (SELECT id, list_filter(l, lambda v, i: list_position(l, v) = i) AS cited FROM c),
e AS (SELECT id, list_transform(range(1, 1 + id % 4 + 1), lambda x: concat('E', CAST(x AS VARCHAR))) AS held FROM a)
SELECT x.id, array_to_string(cited, ',') AS cited, array_to_string(list_filter(cited, lambda v: NOT list_contains(held, v)), ',') AS unknown, array_to_string(list_filter(held, lambda v: NOT list_contains(cited, v)), ',') AS uncited,
 array_to_string(list_sort(list_filter([CASE WHEN n0 > 0 THEN concat('derived:', CAST(n0 AS VARCHAR)) END, CASE WHEN n1 > 0 THEN concat('observation:', CAST(n1 AS VARCHAR)) END], lambda v: v IS NOT NULL)), ',') AS by_kind
FROM (SELECT x.id, cited, held, len(list_filter(cited, lambda v: list_contains(held, v) AND CAST(substr(v, 2) AS BIGINT) % 2 = 0)) AS n0, len(list_filter(cited, lambda v: list_contains(held, v) AND CAST(substr(v, 2) AS BIGINT) % 2 = 1)) AS n1 FROM x JOIN e ON x.id = e.id) x""", "")
def a20(spark, d):
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    n = lambda k: (F.col("id") % k).cast("string")
    answers = docs.withColumn("t", F.concat(F.lit("see [E"), n(5), F.lit("] and [E2, E"), n(9), F.lit("]")))
    held = docs.select("id", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("id") % 4)).alias("k"))
    evidence = held.select("id", F.concat(F.lit("E"), F.col("k").cast("string")).alias("evidence"), F.when(F.col("k") % 2 == 0, "derived").otherwise("observation").alias("kind"))
    return desk.citation_report(answers, evidence, text.citations(F.col("t")))


@R.add("o8_truncated_result", "WITH t AS (SELECT conv_id, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY length(text), text ROWS UNBOUNDED PRECEDING) AS size FROM (SELECT DISTINCT conv_id, text FROM conversations WHERE text IS NOT NULL)) SELECT conv_id, count(*) AS n, max(size) AS size FROM t WHERE size <= 400 GROUP BY conv_id", "")
def o8(spark, d):
    c = fx.read(spark, d, "conversations").where("text is not null").select("conv_id", "text").distinct()
    return desk.longest_first(c, 400, "conv_id", "text").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("size"))


@R.add("o7_sites_by_severity", "SELECT site, max(severity) AS top, CAST(rank() OVER (ORDER BY max(severity) DESC, site) AS BIGINT) AS place FROM ev WHERE event_id % 100 < 95 - 3 * CAST(substr(site, 2) AS BIGINT) GROUP BY site", "ev")
def o7(spark, d):
    from pyspark.sql import Window

    e = fx.site_events(spark, d).where("event_id % 100 < 95 - 3 * cast(substr(site, 2) as bigint)").groupBy("site").agg(F.max("severity").alias("top"))
    return e.withColumn("place", F.row_number().over(Window.orderBy(F.col("top").desc(), "site")).cast("long"))


@R.add("u3_unknown_sources", "SELECT DISTINCT source FROM obs WHERE source NOT IN ('sentinel-2')")
def u3(spark, d):
    known = spark.createDataFrame([("sentinel-2",)], "source string")
    return fx.observations(spark, d).select("source").distinct().join(known, "source", "left_anti")
