"""Adapters from the driver's tables to the engine's core tables.

``observations`` reads ``events``; scenes, sites, runs and position reports follow from it. All
arithmetic is on integers that are divided once, so every engine computes the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.paths import share_package

SITE_BOX = (56.0, 26.0, 56.21, 26.21)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ratio(top: Column, bottom: int) -> Column:
    return top.cast("double") / F.lit(float(bottom))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection per event: obs_id, time, site, scene_id, cls, source, lat, lon, sizes, axis, underway, track."""
    u, e = F.col("user_id"), F.col("event_id")
    cls = (
        F.when(F.col("event_type").isin("view", "click"), "vessel")
        .when(F.col("event_type") == "purchase", "aircraft")
        .when(F.col("event_type") == "signup", "vehicle")
        .otherwise("storage-tank")
    )
    site = F.concat(F.lit("S"), (u % 5).cast("string"))
    length = (40 + (u * 13) % 300).cast("double")
    return (
        read(spark, sf_dir, "events")
        .select(
            e.alias("obs_id"),
            F.col("ts").alias("time"),
            site.alias("site"),
            F.concat(site, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("scene_id"),
            cls.alias("cls"),
            F.when(u % 2 == 0, "sentinel-2").otherwise("sentinel-1").alias("source"),
            _ratio(26000000 + ((u * 7919) % 1000) * 200 + ((e * 31) % 7) * 20, 1000000).alias("lat"),
            _ratio(56000000 + ((u * 104729) % 1000) * 200 + ((e * 17) % 7) * 20, 1000000).alias("lon"),
            length.alias("length_m"),
            (length / F.lit(6.0)).alias("width_m"),
            ((u * 37) % 180).cast("double").alias("axis_deg"),
            F.when(e % 3 == 0, F.lit(None)).otherwise((e % 3 == 1) & (e % 5 == 0)).alias("underway"),
            F.concat(F.lit("T"), u.cast("string")).alias("track_id"),
            F.col("value").alias("value"),
        )
    )


OBSERVATIONS = """obs AS (SELECT event_id AS obs_id, ts AS time, concat('S', CAST(user_id % 5 AS VARCHAR)) AS site,
 concat('S', CAST(user_id % 5 AS VARCHAR), '-', strftime(ts, '%Y-%m-%d')) AS scene_id,
 CASE WHEN event_type IN ('view', 'click') THEN 'vessel' WHEN event_type = 'purchase' THEN 'aircraft' WHEN event_type = 'signup' THEN 'vehicle' ELSE 'storage-tank' END AS cls,
 CASE WHEN user_id % 2 = 0 THEN 'sentinel-2' ELSE 'sentinel-1' END AS source,
 CAST(26000000 + ((user_id * 7919) % 1000) * 200 + ((event_id * 31) % 7) * 20 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lat,
 CAST(56000000 + ((user_id * 104729) % 1000) * 200 + ((event_id * 17) % 7) * 20 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lon,
 CAST(40 + (user_id * 13) % 300 AS DOUBLE) AS length_m, CAST(40 + (user_id * 13) % 300 AS DOUBLE) / CAST(6 AS DOUBLE) AS width_m,
 CAST((user_id * 37) % 180 AS DOUBLE) AS axis_deg,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 AND event_id % 5 = 0 END AS underway,
 concat('T', CAST(user_id AS VARCHAR)) AS track_id, value
 FROM events)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scene of the observations: time, source, sensor, gsd, cloud, clear, box."""
    o = observations(spark, sf_dir)
    day = F.dayofmonth("time").cast("long")
    k = F.substring("site", 2, 1).cast("long")
    return (
        o.groupBy("scene_id", "site")
        .agg(F.min("time").alias("time"), F.min("source").alias("source"), F.count(F.lit(1)).alias("n"))
        .withColumn("sensor", F.when(k % 2 == 0, "optical").otherwise("sar"))
        .withColumn("gsd", F.element_at(F.array(F.lit(10.0), F.lit(0.5), F.lit(3.0), F.lit(30.0), F.lit(0.3)), (k + 1).cast("int")))
        .withColumn("cloud", F.when((day + k) % 4 == 0, F.lit(None).cast("double")).otherwise(((day * 17 + k * 5) % 100).cast("double")))
        .withColumn("clear", F.when((day * 3 + k) % 5 == 0, F.lit(None).cast("double")).otherwise(_ratio((day * 29 + k * 11) % 101, 100)))
        .withColumn("w", _ratio(56000000 + (day % 5) * 20000, 1000000))
        .withColumn("s", _ratio(26000000 + (k % 5) * 20000, 1000000))
        .withColumn("e", F.col("w") + F.lit(0.125))
        .withColumn("n_lat", F.col("s") + F.lit(0.125))
    )


SCENES = """scenes AS (SELECT *, w + CAST(0.125 AS DOUBLE) AS e, s + CAST(0.125 AS DOUBLE) AS n_lat FROM (SELECT scene_id, site, time, source, n,
 CASE WHEN k % 2 = 0 THEN 'optical' ELSE 'sar' END AS sensor, CAST([10.0, 0.5, 3.0, 30.0, 0.3][k + 1] AS DOUBLE) AS gsd,
 CASE WHEN (d + k) % 4 = 0 THEN NULL ELSE CAST((d * 17 + k * 5) % 100 AS DOUBLE) END AS cloud,
 CASE WHEN (d * 3 + k) % 5 = 0 THEN NULL ELSE CAST((d * 29 + k * 11) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS clear,
 CAST(56000000 + (d % 5) * 20000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS w, CAST(26000000 + (k % 5) * 20000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS s
 FROM (SELECT scene_id, site, min(time) AS time, min(source) AS source, count(*) AS n, extract(day FROM min(time)) AS d, CAST(substr(site, 2, 1) AS BIGINT) AS k FROM obs GROUP BY scene_id, site)))"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as monitored sites: name, box, kind, region."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    return n.select(
        F.concat(F.lit("S"), (k % 25).cast("string")).alias("site"),
        F.col("n_name").alias("title"),
        F.col("n_regionkey").cast("long").alias("region"),
        _ratio(56000000 + k * 10000, 1000000).alias("w"),
        _ratio(26000000 + k * 10000, 1000000).alias("s"),
        _ratio(56060000 + k * 10000, 1000000).alias("e"),
        _ratio(26060000 + k * 10000, 1000000).alias("n"),
        F.when(k % 3 == 0, "port").when(k % 3 == 1, "anchorage").otherwise("airbase").alias("kind"),
    )


SITES = """sites AS (SELECT concat('S', CAST(n_nationkey % 25 AS VARCHAR)) AS site, n_name AS title, CAST(n_regionkey AS BIGINT) AS region,
 CAST(56000000 + CAST(n_nationkey AS BIGINT) * 10000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS w, CAST(26000000 + CAST(n_nationkey AS BIGINT) * 10000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS s,
 CAST(56060000 + CAST(n_nationkey AS BIGINT) * 10000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS e, CAST(26060000 + CAST(n_nationkey AS BIGINT) * 10000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS n,
 CASE WHEN n_nationkey % 3 = 0 THEN 'port' WHEN n_nationkey % 3 = 1 THEN 'anchorage' ELSE 'airbase' END AS kind FROM nation)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports from view events: mmsi, time, lat, lon, sog, cog, length."""
    u, e = F.col("user_id"), F.col("event_id")
    return read(spark, sf_dir, "events").where("event_type = 'view'").select(
        u.alias("mmsi"),
        F.col("ts").alias("time"),
        _ratio(26000000 + ((u * 7919) % 1000) * 200 + ((e * 13) % 11) * 20, 1000000).alias("lat"),
        _ratio(56000000 + ((u * 104729) % 1000) * 200 + ((e * 19) % 11) * 20, 1000000).alias("lon"),
        F.when(e % 7 == 0, F.lit(None).cast("double")).otherwise(_ratio((e * 3) % 200, 10)).alias("sog"),
        F.when(e % 11 == 0, F.lit(None).cast("double")).otherwise(((e * 7) % 360).cast("double")).alias("cog"),
        (40 + (u * 13) % 300).cast("double").alias("length_m"),
    )


POSITIONS = """ais AS (SELECT user_id AS mmsi, ts AS time, CAST(26000000 + ((user_id * 7919) % 1000) * 200 + ((event_id * 13) % 11) * 20 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lat,
 CAST(56000000 + ((user_id * 104729) % 1000) * 200 + ((event_id * 19) % 11) * 20 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lon,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST((event_id * 3) % 200 AS DOUBLE) / CAST(10 AS DOUBLE) END AS sog,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 7) % 360 AS DOUBLE) END AS cog,
 CAST(40 + (user_id * 13) % 300 AS DOUBLE) AS length_m FROM events WHERE event_type = 'view')"""


def pixels(spark: SparkSession, sf_dir: str, grid: int = 64) -> DataFrame:
    """Two-date reflectance pixels from line items: row, col and six bands before and after."""
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("long")
    band = lambda k: _ratio((o * (k + 3) + p * (2 * k + 1) + n * 7) % 400, 1000)
    names = ("blue", "green", "red", "nir", "swir16", "swir22")
    return read(spark, sf_dir, "lineitem").select(
        (o % grid).alias("row"), (p % grid).alias("col"), *[band(i).alias(f"{b}_b") for i, b in enumerate(names)], *[band(i + 9).alias(f"{b}_a") for i, b in enumerate(names)]
    )


_BANDS = ("blue", "green", "red", "nir", "swir16", "swir22")
PIXELS = "pix AS (SELECT l_orderkey % 64 AS \"row\", l_partkey % 64 AS col, " + ", ".join(
    f"CAST((l_orderkey * {i + k + 3} + l_partkey * {2 * (i + k) + 1} + CAST(l_linenumber AS BIGINT) * 7) % 400 AS DOUBLE) / CAST(1000 AS DOUBLE) AS {b}_{side}"
    for side, k in (("b", 0), ("a", 9))
    for i, b in enumerate(_BANDS)
) + " FROM lineitem)"


def band_pixels(spark: SparkSession, sf_dir: str, side: int = 72) -> DataFrame:
    """Images of four bands, one for every thousand orders: a rooftop, and an aircraft whose way follows from the customers."""
    k, image = F.col("k"), F.col("image")
    images = read(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("image")).agg(F.sum("o_custkey").alias("k"))
    # One image makes side x side rows, so tasks are told by images and not by the few bytes they come from.
    facts = images.repartition(max(64, spark.sparkContext.defaultParallelism), image).select(image, (120 + k % 200).cast("double").alias("speed"), F.radians(((k * 37) % 360).cast("double")).alias("a"), F.when(k % 2 == 1, 3.5).otherwise(1.2).alias("sl"), F.when(k % 2 == 1, 1.0).otherwise(1.2).alias("sa"))
    cells = F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))
    rows = facts.withColumn("row", F.explode(cells)).withColumn("col", F.explode(cells))
    r, c = F.col("row"), F.col("col")
    roof = F.exp(-((r - 10) * (r - 10) + (c - 60) * (c - 60)).cast("double") / 2.88) * 0.25

    def band(i: int, seconds: float) -> Column:
        y = r - (F.lit(36.0) - F.cos("a") * F.col("speed") / 10.0 * seconds)
        x = c - (F.lit(30.0) + F.sin("a") * F.col("speed") / 10.0 * seconds)
        along, across = x * F.sin("a") - y * F.cos("a"), x * F.cos("a") + y * F.sin("a")
        noise = _ratio((r * 131 + c * 71 + image * 17 + r * c * 7 + i * 13) % 101, 12500)
        return noise + 0.2 + F.exp(-(along * along / (F.col("sl") * F.col("sl") * 2.0)) - across * across / (F.col("sa") * F.col("sa") * 2.0)) * 0.25 + roof

    return rows.select("image", "row", "col", *[band(i, t).alias(b) for i, (b, t) in enumerate(BAND_TIMES.items())])


#: Seconds of each band of ``band_pixels`` after the first.
BAND_TIMES = {"blue": 0.0, "nir": 0.264, "green": 0.527, "red": 1.005}


def _band_sql(i: int, t: float) -> str:
    y, x = f'("row" - (36.0::DOUBLE - cos(a) * speed / 10.0::DOUBLE * {t}::DOUBLE))', f"(col - (30.0::DOUBLE + sin(a) * speed / 10.0::DOUBLE * {t}::DOUBLE))"
    noise = f'CAST(("row" * 131 + col * 71 + image * 17 + "row" * col * 7 + {i} * 13) % 101 AS DOUBLE) / CAST(12500 AS DOUBLE)'
    blob = f"exp(-(pow({x} * sin(a) - {y} * cos(a), 2) / (sl * sl * 2.0::DOUBLE)) - pow({x} * cos(a) + {y} * sin(a), 2) / (sa * sa * 2.0::DOUBLE)) * 0.25::DOUBLE"
    return f'{noise} + 0.2::DOUBLE + {blob} + exp(-CAST(("row" - 10) * ("row" - 10) + (col - 60) * (col - 60) AS DOUBLE) / 2.88::DOUBLE) * 0.25::DOUBLE'


BAND_PIXELS = (
    """img AS (SELECT image, CAST(120 + k % 200 AS DOUBLE) AS speed, radians(CAST((k * 37) % 360 AS DOUBLE)) AS a, CASE k % 2 WHEN 1 THEN 3.5::DOUBLE ELSE 1.2::DOUBLE END AS sl, CASE k % 2 WHEN 1 THEN 1.0::DOUBLE ELSE 1.2::DOUBLE END AS sa
 FROM (SELECT o_orderkey // 1000 AS image, CAST(sum(o_custkey) AS BIGINT) AS k FROM orders GROUP BY 1)),
 bandpix AS MATERIALIZED (SELECT image, "row", col, """
    + ", ".join(f"{_band_sql(i, t)} AS {b}" for i, (b, t) in enumerate(BAND_TIMES.items()))
    + """ FROM img, range(72) x("row"), range(72) y(col))"""
)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track of the observations, with a status by its number."""
    last = F.struct("time", "obs_id")
    t = observations(spark, sf_dir).groupBy("site", "track_id").agg(
        F.max_by("cls", last).alias("cls"), F.count(F.lit(1)).alias("n_obs"), F.max("length_m").alias("length_m"),
        F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.max_by("lat", last).alias("lat"), F.max_by("lon", last).alias("lon"),
    )
    k = F.substring("track_id", 2, 18).cast("long") % 3
    return t.withColumn("status", F.when(k == 0, "departed").when(k == 1, "lost").otherwise("active"))


TRACKS = """tracks AS (SELECT *, CASE CAST(substr(track_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'departed' WHEN 1 THEN 'lost' ELSE 'active' END AS status
 FROM (SELECT site, track_id, arg_max(cls, (time, obs_id)) AS cls, count(*) AS n_obs, max(length_m) AS length_m, min(time) AS first_seen, max(time) AS last_seen,
 arg_max(lat, (time, obs_id)) AS lat, arg_max(lon, (time, obs_id)) AS lon FROM obs GROUP BY site, track_id))"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen links of all observations, and for every fifth a rival: the track numbered one higher."""
    o = observations(spark, sf_dir)
    own = o.select("site", "obs_id", "track_id", _ratio(F.col("obs_id") % 11, 10).alias("prob"), F.lit(1).alias("chosen"))
    next_ = F.concat(F.lit("T"), (F.substring("track_id", 2, 18).cast("long") + 1).cast("string"))
    rival = o.where("obs_id % 5 = 0").select("site", "obs_id", next_.alias("track_id"), _ratio(F.col("obs_id") % 7, 10).alias("prob"), F.lit(0).alias("chosen"))
    return own.unionByName(rival)


LINKS = """links AS (SELECT site, obs_id, track_id, CAST(obs_id % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS prob, 1 AS chosen FROM obs
 UNION ALL SELECT site, obs_id, concat('T', CAST(CAST(substr(track_id, 2) AS BIGINT) + 1 AS VARCHAR)), CAST(obs_id % 7 AS DOUBLE) / CAST(10 AS DOUBLE), 0 FROM obs WHERE obs_id % 5 = 0)"""


def site_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored event per observation: kind by class, severity from the id, a detail map."""
    kind = F.when(F.col("cls") == "vessel", "dark_vessel").when(F.col("cls") == "aircraft", "arrival").when(F.col("cls") == "vehicle", "change_new_water").otherwise("loitering")
    detail = F.create_map(F.lit("lat"), F.col("lat").cast("string"), F.lit("length_m"), F.col("length_m").cast("int").cast("string"), F.lit("z"), (F.col("obs_id") % 9).cast("string"), F.lit("track_ids"), F.col("track_id"))
    return observations(spark, sf_dir).select(
        F.col("obs_id").alias("event_id"), "site", "time", kind.alias("kind"), _ratio(F.col("obs_id") % 100, 100).alias("severity"), "lat", "lon", "track_id", detail.alias("detail")
    )


SITE_EVENTS = """ev AS (SELECT obs_id AS event_id, site, time, CASE cls WHEN 'vessel' THEN 'dark_vessel' WHEN 'aircraft' THEN 'arrival' WHEN 'vehicle' THEN 'change_new_water' ELSE 'loitering' END AS kind,
 CAST(obs_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS severity, lat, lon, track_id, length_m FROM obs)"""
