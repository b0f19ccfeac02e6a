"""Scalar library over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import domain, geo, text
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql
_LON0, _LAT0 = 56.1, 26.1


def _obs(spark, d):
    return fx.observations(spark, d)


@R.add("f1_parse_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events", "")
def f1(spark, d):
    e = fx.read(spark, d, "events")
    form = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", F.date_format(domain.parsed_time(form), "yyyy-MM-dd HH:mm:ss").alias("time"))


@R.add("f3_period_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month, concat(strftime(ts, '%Y'), '-Q', CAST(extract(quarter FROM ts) AS VARCHAR)) AS quarter, strftime(ts, '%Y') AS year FROM events", "")
def f3(spark, d):
    return fx.read(spark, d, "events").select("event_id", *[domain.period_key(F.col("ts"), p).alias(p) for p in ("day", "week", "month", "quarter", "year")])


@R.add("f6_distance", "SELECT obs_id, round(sqrt(pow((lon - CAST(56.1 AS DOUBLE)) * 111320.0::DOUBLE * cos(radians((lat + CAST(26.1 AS DOUBLE)) / 2)), 2) + pow((lat - CAST(26.1 AS DOUBLE)) * 110574.0::DOUBLE, 2)), 3) AS metres FROM obs")
def f6(spark, d):
    return _obs(spark, d).select("obs_id", F.round(geo.distance_m(F.lit(_LAT0), F.lit(_LON0), F.col("lat"), F.col("lon")), 3).alias("metres"))


@R.add("f7_local_xy", "SELECT obs_id, round((lon - CAST(56.1 AS DOUBLE)) * 111320.0::DOUBLE * cos(radians(CAST(26.1 AS DOUBLE))), 3) AS x, round((lat - CAST(26.1 AS DOUBLE)) * 110540.0::DOUBLE, 3) AS y FROM obs")
def f7(spark, d):
    return _obs(spark, d).select("obs_id", F.round(geo.local_x(F.col("lon"), F.lit(_LAT0), F.lit(_LON0)), 3).alias("x"), F.round(geo.local_y(F.col("lat"), F.lit(_LAT0)), 3).alias("y"))


@R.add("f8_bearing", "SELECT obs_id, round(fmod(degrees(atan2((lon - CAST(56.1 AS DOUBLE)) * cos(radians((lat + CAST(26.1 AS DOUBLE)) / 2)), lat - CAST(26.1 AS DOUBLE))) + 360, 360), 3) AS degrees FROM obs")
def f8(spark, d):
    k = F.cos(F.radians((F.col("lat") + F.lit(_LAT0)) / 2))
    b = F.pmod(F.degrees(F.atan2((F.col("lon") - F.lit(_LON0)) * k, F.col("lat") - F.lit(_LAT0))) + 360, F.lit(360.0))
    return _obs(spark, d).select("obs_id", F.round(b, 3).alias("degrees"))


@R.add("f9_haversine", "SELECT obs_id, round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(lat - CAST(26.1 AS DOUBLE)) / 2), 2) + cos(radians(CAST(26.1 AS DOUBLE))) * cos(radians(lat)) * pow(sin(radians(lon - CAST(56.1 AS DOUBLE)) / 2), 2))), 6) AS km FROM obs")
def f9(spark, d):
    return _obs(spark, d).select("obs_id", F.round(geo.haversine_km(F.lit(_LAT0), F.lit(_LON0), F.col("lat"), F.col("lon")), 6).alias("km"))


@R.add("f10_axis_difference", "SELECT obs_id, least(fmod(abs(axis_deg - 30), 180), 180 - fmod(abs(axis_deg - 30), 180)) AS diff FROM obs")
def f10(spark, d):
    return _obs(spark, d).select("obs_id", geo.axis_difference(F.col("axis_deg"), F.lit(30.0)).alias("diff"))


@R.add("f12_utm_zone", "SELECT obs_id, CAST(32600 + floor((lon + 180) / 6) % 60 + 1 AS INTEGER) AS epsg FROM obs")
def f12(spark, d):
    return _obs(spark, d).select("obs_id", geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


@R.add("f13_map_tiles", "SELECT obs_id, CAST(floor((lon + 180) / 360.0::DOUBLE * 4096) AS INTEGER) AS col, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096) AS INTEGER) AS \"row\" FROM obs")
def f13(spark, d):
    col, row = geo.tile_of(F.col("lat"), F.col("lon"), 12)
    return _obs(spark, d).select("obs_id", col.alias("col"), row.alias("row"))


@R.add("f13_tile_boxes", "SELECT l_orderkey, l_linenumber, round(x / 64.0::DOUBLE * 360 - 180, 9) AS w, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 64.0::DOUBLE)))), 9) AS s, round((x + 1) / 64.0::DOUBLE * 360 - 180, 9) AS e, round(degrees(atan(sinh(pi() * (1 - 2 * y / 64.0::DOUBLE)))), 9) AS n_lat FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 64 AS x, l_partkey % 64 AS y FROM lineitem)", "")
def f13b(spark, d):
    w, s, e, n = geo.tile_box(F.col("l_orderkey") % 64, F.col("l_partkey") % 64, 6)
    return fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(v, 9).alias(c) for v, c in ((w, "w"), (s, "s"), (e, "e"), (n, "n_lat"))])


@R.add("f16_family", "SELECT obs_id, CASE cls WHEN 'storage-tank' THEN 'tank' ELSE cls END AS family FROM obs")
def f16(spark, d):
    return _obs(spark, d).select("obs_id", domain.family(F.col("cls")).alias("family"))


@R.add("f18_error_model", "SELECT obs_id, greatest(1.5 * 10, 2.0)::DOUBLE + CAST(0.05 AS DOUBLE) * length_m AS sigma, CASE WHEN source = 'sentinel-1' THEN greatest(40.0::DOUBLE, CAST(0.25 AS DOUBLE) * length_m) ELSE greatest(20.0::DOUBLE, CAST(0.1 AS DOUBLE) * length_m, 1.0::DOUBLE) END AS length_sigma FROM obs")
def f18(spark, d):
    gsd = domain.gsd_of(F.lit(None).cast("double"), F.col("source"))
    return _obs(spark, d).select("obs_id", domain.position_sigma(gsd, F.col("length_m")).alias("sigma"), domain.length_sigma(F.col("source"), gsd, F.col("length_m")).alias("length_sigma"))


@R.add("f20_gaussians", "SELECT obs_id, round(exp(-0.5::DOUBLE * pow(axis_deg / 40, 2)) / (sqrt(2 * pi()) * 40), 12) AS g1, round(exp(-0.5::DOUBLE * pow(axis_deg / 40, 2)) / (2 * pi() * 1600), 12) AS g2 FROM obs")
def f20(spark, d):
    s = F.lit(40.0)
    return _obs(spark, d).select("obs_id", F.round(domain.gauss1(F.col("axis_deg"), s), 12).alias("g1"), F.round(domain.gauss2(F.col("axis_deg"), s), 12).alias("g2"))


@R.add("f21_beam_f22_severity", "SELECT obs_id, CASE WHEN width_m < length_m THEN width_m ELSE length_m / 6 END AS beam, CAST(CASE WHEN cls = 'vessel' THEN CASE WHEN length_m >= 250 THEN 0.85 WHEN length_m >= 150 THEN 0.6 WHEN length_m >= 80 THEN 0.45 ELSE 0.25 END WHEN cls = 'aircraft' THEN 0.6 ELSE 0.2 END AS DOUBLE) AS severity, CASE WHEN length_m >= 250 THEN 'very large (>=250 m)' WHEN length_m >= 100 THEN 'large (100-250 m)' WHEN length_m >= 40 THEN 'medium (40-100 m)' ELSE 'small (<40 m)' END AS size FROM obs")
def f21(spark, d):
    c = F.col
    return _obs(spark, d).select("obs_id", domain.beam(c("length_m"), c("width_m")).alias("beam"), domain.object_severity(c("cls"), c("length_m")).cast("double").alias("severity"), domain.size_class(c("length_m")).alias("size"))


@R.add("f23_labels", "SELECT obs_id, concat(CAST(CAST(length_m AS BIGINT) AS VARCHAR), ' m ') AS word, round(length_m * CAST(1.943844 AS DOUBLE), 6) AS knots FROM obs")
def f23(spark, d):
    return _obs(spark, d).select("obs_id", domain.size_word(F.col("length_m")).alias("word"), F.round(F.col("length_m") * domain.KNOTS, 6).alias("knots"))


@R.add("f24_record_keys", "SELECT obs_id, substr(sha1(concat_ws('|', scene_id, source, cls, printf('%.6f', lat), printf('%.6f', lon))), 1, 16) AS key, concat('T', substr(sha1(CAST(obs_id AS VARCHAR)), 1, 11)) AS track FROM obs")
def f24(spark, d):
    c = F.col
    return _obs(spark, d).select("obs_id", domain.observation_key(c("scene_id"), c("source"), c("cls"), c("lat"), c("lon")).alias("key"), domain.track_key(c("obs_id")).alias("track"))


_SUN = """WITH t AS (SELECT obs_id, lat, lon, (epoch(time) - 946728000.0::DOUBLE) / 86400.0::DOUBLE AS d FROM (SELECT *, date_trunc('second', time) AS time2 FROM obs) x(obs_id, time0, site, scene_id, cls, source, lat, lon, length_m, width_m, axis_deg, underway, track_id, value, time)),
g AS (SELECT *, radians(fmod(357.529::DOUBLE + 0.98560028::DOUBLE * d, 360)) AS g, 280.459::DOUBLE + 0.98564736::DOUBLE * d AS q, radians(23.439::DOUBLE - 0.00000036::DOUBLE * d) AS tilt FROM t),
l AS (SELECT *, radians(q + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(2 * g)) AS lam FROM g),
s AS (SELECT *, asin(sin(tilt) * sin(lam)) AS dec, radians(fmod(280.46061837::DOUBLE + 360.98564736629::DOUBLE * d, 360) + lon) - atan2(cos(tilt) * sin(lam), cos(lam)) AS ha FROM l)
SELECT obs_id, round(degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(ha))), 4) AS elevation FROM s"""


@R.add("f26_sun_elevation", _SUN)
def f26(spark, d):
    t = F.unix_seconds(F.col("time").cast("timestamp")).cast("double")
    return _obs(spark, d).select("obs_id", F.round(geo.sun_elevation(t, F.col("lat"), F.col("lon")), 4).alias("elevation"))


@R.add("f28_decibel_f29_ratio", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN 10 * log10(l_discount) END, 6) AS db, round((l_tax - l_discount) / nullif(l_tax + l_discount, 0), 6) AS nd FROM lineitem", "")
def f28(spark, d):
    c = F.col
    return fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(domain.decibel(c("l_discount")), 6).alias("db"), F.round(domain.normalised_difference(c("l_tax"), c("l_discount")), 6).alias("nd"))


@R.add("f30_dequantise", "SELECT l_orderkey, l_linenumber, CASE WHEN n <> -128 THEN round(sign(n) * pow(n / 127.5::DOUBLE, 2), 9) END AS v FROM (SELECT l_orderkey, l_linenumber, l_partkey % 256 - 128 AS n FROM lineitem)", "")
def f30(spark, d):
    return fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(domain.dequantised(F.col("l_partkey") % 256 - 128), 9).alias("v"))


@R.add("f31_unit_vectors", "SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(e[64] / sqrt(list_dot_product(e, e)), 6) AS last FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", "")
def f31(spark, d):
    from orbweave.operators import vectors

    e = fx.read(spark, d, "embeddings").withColumn("u", vectors.unit(F.col("embedding")))
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"))


@R.add("f32_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "")
def f32(spark, d):
    return fx.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_INTENT_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in text.INTENTS.items()) + "], lambda x: x IS NOT NULL))"


@R.add("f33_intents", f"SELECT conv_id, turn, array_to_string({_INTENT_SQL}, ',') AS intents FROM conversations", "")
def f33(spark, d):
    return fx.read(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.intents(F.col("text")), ",").alias("intents"))


@R.add("f35_hosts", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages", "")
def f35(spark, d):
    return fx.read(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@R.add("f37_gsd_text", "SELECT scene_id, CASE WHEN gsd < 1 THEN concat(CAST(CAST(round(gsd * 100) AS BIGINT) AS VARCHAR), ' cm') ELSE concat(CAST(CAST(round(gsd) AS BIGINT) AS VARCHAR), ' m') END AS gsd FROM scenes", "scenes")
def f37(spark, d):
    return fx.scenes(spark, d).select("scene_id", domain.gsd_text(F.col("gsd")).alias("gsd"))


@R.add("pf12_allowed_links", "SELECT page_id, regexp_matches(url, '^https://') AND lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) LIKE '%.example.com' AS allowed FROM pages", "")
def pf12(spark, d):
    return fx.read(spark, d, "pages").select("page_id", text.allowed(F.col("url"), [], [".example.com"]).alias("allowed"))


_BOUNDARY = text.BOUNDARY.replace("'", "''")


@R.add("pf13_declined_questions", f"SELECT conv_id, turn, regexp_matches(text, '(?i){_BOUNDARY}') AS declined FROM conversations", "")
def pf13(spark, d):
    return fx.read(spark, d, "conversations").select("conv_id", "turn", text.declined(F.col("text")).alias("declined"))


@R.add("a20_citations", "SELECT obs_id, concat('[E', CAST(obs_id % 7 AS VARCHAR), '] and [E', CAST(obs_id % 3 AS VARCHAR), ', E9] again [E9].') AS answer, array_to_string(list_distinct_ordered, ',') AS cited, len(list_distinct_ordered) AS n FROM (SELECT obs_id, CASE WHEN obs_id % 7 = obs_id % 3 THEN [concat('E', CAST(obs_id % 7 AS VARCHAR)), 'E9'] ELSE [concat('E', CAST(obs_id % 7 AS VARCHAR)), concat('E', CAST(obs_id % 3 AS VARCHAR)), 'E9'] END AS list_distinct_ordered FROM obs)")
def a20(spark, d):
    e = lambda k: (F.col("obs_id") % k).cast("string")
    answer = F.concat(F.lit("[E"), e(7), F.lit("] and [E"), e(3), F.lit(", E9] again [E9]."))
    o = _obs(spark, d).select("obs_id", answer.alias("answer"))
    cited = text.citations(F.col("answer"))
    return o.select("obs_id", "answer", F.array_join(cited, ",").alias("cited"), F.size(cited).cast("long").alias("n"))


@R.add("f34_normal_citations", "SELECT obs_id, concat('x ', CASE WHEN obs_id % 2 = 0 THEN concat('[E', CAST(obs_id % 5 AS VARCHAR), '][E', CAST(obs_id % 5 + 1 AS VARCHAR), ']') ELSE concat('[E', CAST(obs_id % 5 AS VARCHAR), ']') END) AS answer FROM obs")
def f34(spark, d):
    k = (F.col("obs_id") % 5).cast("string")
    raw = F.concat(F.lit("x "), F.when(F.col("obs_id") % 2 == 0, F.concat(F.lit("【E"), k, F.lit("–E"), (F.col("obs_id") % 5 + 1).cast("string"), F.lit("】"))).otherwise(F.concat(F.lit("【 E"), k, F.lit(" 】"))))
    return _obs(spark, d).select("obs_id", text.normalised_citations(raw).alias("answer"))
