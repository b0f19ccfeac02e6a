"""Events of a site against its own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import domain, geo
from orbweave.operators.joins import covering, nearest, range_join
from orbweave.operators.windows import prefix_robust_z, with_rest
from orbweave.sources.paths import cut

# Pair search, crowding, history density and roll-up.
STS_LENGTH, STS_GAP, STS_AXIS, CROWDED = 60.0, 60.0, 25.0, 40
BANDWIDTH = {"vessel": 300.0, "aircraft": 60.0, "vehicle": 25.0}
UNUSUAL_RATE, MIN_LOOKS, MIN_HISTORY = 0.02, 6, 30
INDIVIDUAL = 4
#: Width of the cells that boxes of looks are cut into, in degrees.
COVER_CELL_DEG = 0.05
CLEAR = 0.85


def clear_look(clear: Column) -> Column:
    """A look counts as clear unless its clear share is known and low."""
    return F.coalesce(clear, F.lit(1.0)) >= CLEAR


def count_anomalies(obs: DataFrame, least: int = 4, score: float = 3.0) -> DataFrame:
    """Scene counts per (site, family, source) that stray from all counts before them."""
    counts = obs.groupBy("site", domain.family(F.col("cls")).alias("family"), "source", "scene_id").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("time"))
    rows = prefix_robust_z(counts, ["site", "family", "source"], ["time", "scene_id"], "n", least).where(F.abs("z") >= score)
    kind = F.when(F.col("z") > 0, "count_spike").otherwise("count_drop")
    return rows.select(
        domain.record_key(kind, F.col("site"), F.col("family"), F.col("scene_id")).alias("event_id"),
        "site", "family", "source", "scene_id", kind.alias("kind"), "n", "median",
        F.round("z", 1).alias("z"),
        F.round(F.least(F.lit(1.0), F.lit(0.3) + F.abs("z") / 10), 2).alias("severity"),
    )


def alongside_pairs(obs: DataFrame) -> DataFrame:
    """Hulls lying side by side in one scene: both known and different motion, crossing axes and gaps rule a pair out.

    Reach is that of the longest hull and widest beam at stake, so the cells of the range join are as wide.
    """
    vessels = obs.where((F.col("cls") == "vessel") & (F.coalesce("length_m", F.lit(0.0)) >= STS_LENGTH))
    track = F.col("track_id") if "track_id" in vessels.columns else F.lit(None).cast("string")
    vessels = vessels.select("obs_id", track.alias("track_id"), "site", "scene_id", "lat", "lon", "length_m", "axis_deg", "underway", "source", domain.beam(F.col("length_m"), F.col("width_m")).alias("beam"))
    centre = vessels.groupBy("site").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    reach = vessels.agg(F.max(F.col("length_m") / 2), F.max("beam")).first()
    if reach[0] is None:
        return vessels.limit(0)
    width = reach[0] + 2 * reach[1] + STS_GAP
    at = vessels.join(centre, "site").withColumn("x", geo.local_x(F.col("lon"), F.col("lat0"), F.col("lon0"))).withColumn("y", geo.local_y(F.col("lat"), F.col("lat0")))
    by_scene = at.groupBy("site", "scene_id").agg((F.max("length_m") / 2 + F.max("beam") * 2 + STS_GAP).alias("reach"))
    at = at.join(by_scene, ["site", "scene_id"]).drop("lat0", "lon0")
    pairs = range_join(at, at, ["site", "scene_id"], "x", "y", width, F.col("l_obs_id") < F.col("r_obs_id")).where(F.col("distance") <= F.col("l_reach"))
    diff = geo.axis_difference(F.col("l_axis_deg"), F.col("r_axis_deg"))
    axis = F.radians(F.coalesce("l_axis_deg", "r_axis_deg"))
    dx, dy = F.col("r_x") - F.col("l_x"), F.col("r_y") - F.col("l_y")
    along = F.coalesce(F.abs(dx * F.sin(axis) + dy * F.cos(axis)), F.lit(0.0))
    lateral = F.coalesce(F.abs(dx * F.cos(axis) - dy * F.sin(axis)), F.col("distance"))
    gap = lateral - (F.col("l_beam") + F.col("r_beam")) / 2
    return pairs.withColumn("axis_diff", diff).withColumn("gap", gap).where(
        ~F.coalesce(F.col("l_underway") != F.col("r_underway"), F.lit(False))
        & F.coalesce(F.col("axis_diff") <= STS_AXIS, F.lit(True))
        & (along <= F.greatest(F.coalesce("l_length_m", F.lit(0.0)), F.coalesce("r_length_m", F.lit(0.0))) / 2)
        & (F.col("gap") <= STS_GAP)
    )


def sts_candidates(obs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Rafted pairs as events; scenes give the clear share.

    Severity rises with size and with the scenes in which the same two tracks lay together (two more
    at most; sightings without a track count once), and falls in crowds and haze.
    """
    crowd = obs.where("cls = 'vessel'").groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_vessels"))
    lesser = F.least("l_length_m", "r_length_m")
    pairs = alongside_pairs(obs).withColumnRenamed("l_scene_id", "scene_id").join(crowd, "scene_id").join(scenes.select("scene_id", "clear"), "scene_id", "left")
    ends = {"_t1": F.least("l_track_id", "r_track_id"), "_t2": F.greatest("l_track_id", "r_track_id")}
    pairs = cut(pairs.withColumns({k: F.when(F.col("l_track_id").isNotNull() & F.col("r_track_id").isNotNull(), v) for k, v in ends.items()}))
    together = pairs.where("_t1 is not null").groupBy("_t1", "_t2").agg(F.count_distinct("scene_id").alias("repeats"))
    pairs = pairs.join(together, ["_t1", "_t2"], "left")
    severity = (
        F.lit(0.45)
        + F.least(F.coalesce("repeats", F.lit(1)) - 1, F.lit(2)) * 0.1
        + F.when(lesser >= 150, 0.15).otherwise(0.0)
        - F.when(F.col("n_vessels") > CROWDED, 0.2).otherwise(0.0)
        - F.when(clear_look(F.col("clear")), 0.0).otherwise(0.1)
    )
    keys = F.array_sort(F.array(F.col("l_obs_id").cast("string"), F.col("r_obs_id").cast("string")))
    return pairs.select(
        domain.record_key(F.lit("sts"), F.get(keys, F.lit(0)), F.get(keys, F.lit(1))).alias("event_id"),
        "scene_id",
        F.col("l_obs_id").alias("obs_a"),
        F.col("r_obs_id").alias("obs_b"),
        F.round("distance", 1).alias("separation_m"),
        F.round(F.greatest(F.col("gap"), F.lit(0.0)), 1).alias("gap_m"),
        F.round("axis_diff", 1).alias("axis_diff_deg"),
        F.round(F.least(F.greatest(severity, F.lit(0.15)), F.lit(0.9)), 2).alias("severity"),
    )


def fat_hulls(obs: DataFrame) -> DataFrame:
    """Hulls that a coarse detector saw as one wide blob."""
    length, width = F.coalesce("length_m", F.lit(0.0)), F.coalesce("width_m", F.lit(0.0))
    crowd = F.count(F.when(F.col("cls") == "vessel", 1)).over(Window.partitionBy("scene_id"))
    return (
        obs.withColumn("n_vessels", crowd)
        .where((F.col("cls") == "vessel") & F.col("source").isin("sentinel-2", "sentinel-1", "landsat") & (length >= 120) & (width >= F.lit(0.3) * length))
        .select(
            domain.record_key(F.lit("sts1"), F.col("obs_id").cast("string")).alias("event_id"), "obs_id", "scene_id",
            F.round(length / F.greatest(width, F.lit(1.0)), 2).alias("aspect"),
            F.round(F.lit(0.3) - F.when(F.col("n_vessels") > CROWDED, 0.15).otherwise(0.0), 2).alias("severity"),
        )
    )


def unusual_locations(obs: DataFrame, scenes: DataFrame, recent: int = 3) -> DataFrame:
    """Objects not under way in the last clear looks, where the site's history has next to none.

    Density is a Gaussian kernel over earlier clear looks within three bandwidths, per look that covered
    the place: of a scene with a box (w, s, e, n_lat) only what lies inside was looked at, one without
    a box covers everything. Fewer than ``MIN_LOOKS`` such looks tell nothing.
    """
    looks = scenes.where(clear_look(F.col("clear"))).withColumn("look", F.row_number().over(Window.partitionBy("site").orderBy("time", "scene_id")) - 1)
    looks = looks.withColumn("looks", F.count(F.lit(1)).over(Window.partitionBy("site")))
    boxed = {"w", "s", "e", "n_lat"} <= set(scenes.columns)
    sides = ["w", "s", "e", "n_lat"] if boxed else []
    whole = F.greatest(*[F.col(c).isNull() for c in sides]) if boxed else F.lit(True)
    boxes = cut(looks.select("site", F.col("look").alias("then"), *sides, whole.alias("whole")))
    looks = looks.select("site", "scene_id", "look", "looks")
    centre = obs.groupBy("site").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    bandwidth = F.element_at(F.create_map(*[F.lit(v) for kv in BANDWIDTH.items() for v in kv]), F.col("family"))
    seen = (
        obs.withColumn("family", domain.family(F.col("cls")))
        .withColumn("h", bandwidth)
        .where("h is not null")
        .join(looks, ["site", "scene_id"])
        .join(centre, "site")
        .withColumn("x", geo.local_x(F.col("lon"), F.col("lat0"), F.col("lon0")))
        .withColumn("y", geo.local_y(F.col("lat"), F.col("lat0")))
        .select("obs_id", "site", "family", "h", "look", "looks", "lat", "lon", "x", "y", "length_m", "underway")
    )
    new = seen.where((F.col("looks") > MIN_LOOKS) & (F.col("look") >= F.greatest(F.lit(MIN_LOOKS), F.col("looks") - recent)) & ~F.coalesce("underway", F.lit(False)))
    per_look = seen.groupBy("site", "family", "look").agg(F.count(F.lit(1)).alias("n"))
    depth = new.select("site", "family", F.col("look").alias("k")).distinct().join(per_look, ["site", "family"]).where("look < k").groupBy("site", "family", "k").agg(F.sum("n").alias("history"))
    new = new.join(depth.where(F.col("history") >= MIN_HISTORY).withColumnRenamed("k", "look"), ["site", "family", "look"])
    # Cells of three bandwidths hold all that the kernel reaches; the nearest is searched for unusual places only.
    cell = lambda v: F.floor(F.col(v) / (F.col("h") * 3))
    past = seen.select("site", "family", F.col("look").alias("past"), F.col("x").alias("px"), F.col("y").alias("py"), F.struct(cell("x").alias("cx"), cell("y").alias("cy")).alias("_own"))
    around = F.sequence(F.lit(-1), F.lit(1))
    cells = F.flatten(F.transform(around, lambda i: F.transform(around, lambda j: F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")))))
    new = cut(new)
    d2 = F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)
    # Pairs are many though both sides are small files: dealt out by cell, not made in the few tasks that read a broadcast's other side.
    pairs = new.withColumn("_cell", F.explode(cells)).join(past.hint("merge"), ["site", "family"]).where((F.col("_cell") == F.col("_own")) & (F.col("past") < F.col("look"))).withColumn("d2", d2)
    reach = F.col("h") * 3
    weight = F.when(F.col("d2") <= reach * reach, F.exp(-F.col("d2") / (F.col("h") * F.col("h") * 2))).otherwise(0.0)
    density = pairs.groupBy("obs_id").agg(F.sum(weight).alias("density"))
    # Looks that cover everything, up to each look, and those whose box holds the place.
    always = boxes.groupBy("site").agg(F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("then")))).alias("_always"))
    looked = new.join(always, "site").select("obs_id", F.size(F.filter("_always", lambda k: k < F.col("look"))).alias("_n"))
    if boxed:
        held = covering(new.select("obs_id", "site", "look", "lat", "lon"), boxes.where(~F.col("whole")), ["site"], "lon", "lat", COVER_CELL_DEG).where("b_then < look")
        looked = looked.unionByName(held.groupBy("obs_id").agg(F.count(F.lit(1)).cast("int").alias("_n")))
    looked = looked.groupBy("obs_id").agg(F.sum("_n").alias("looked")).where(F.col("looked") >= MIN_LOOKS)
    rare = new.join(looked, "obs_id").join(density, "obs_id", "left").withColumn("rate", F.coalesce("density", F.lit(0.0)) / F.col("looked")).where(F.col("rate") < UNUSUAL_RATE)
    rare = cut(rare.select("obs_id", "site", "family", "h", "look", "looked", "length_m", "underway", "x", "y", "rate"))
    gap = nearest(rare.select("obs_id", "site", "family", "look", "x", "y"), seen.select("site", "family", "x", "y", "look"), ["site", "family"], "x", "y", ["obs_id"], F.col("r_look") < F.col("look"))
    found = rare.join(gap, "obs_id")
    severity = (
        F.lit(0.35)
        + F.lit(0.15) * F.least(F.col("nearest") / (F.col("h") * 10), F.lit(1.0))
        + F.when((F.col("family") == "vessel") & (F.coalesce("length_m", F.lit(0.0)) >= 150), 0.15).otherwise(0.0)
        + F.when(F.col("family") == "aircraft", 0.1).otherwise(0.0)
        - F.when(F.col("underway").isNull() & (F.col("family") == "vessel"), 0.1).otherwise(0.0)
    )
    return found.select(
        domain.record_key(F.lit("unusual"), F.col("obs_id").cast("string")).alias("event_id"),
        "obs_id", "site", "family", F.col("looked").alias("looks"),
        F.round("rate", 4).alias("expected_per_look"), F.round("nearest", 0).alias("nearest_past_m"),
        F.round(F.least(severity, F.lit(0.85)), 2).alias("severity"),
    )


def rollup(turnover: DataFrame, kind: str, crowded: Column | None = None) -> DataFrame:
    """Arrivals or departures: the longest few of a scene one by one, and one row for a busy scene as a whole."""
    scale = F.when(crowded, 0.6).otherwise(1.0) if crowded is not None else F.lit(1.0)
    order = [F.coalesce("length_m", F.lit(0.0)).desc(), F.col("track_id")]
    rows = with_rest(turnover, ["site", "scene_id"], order, INDIVIDUAL)
    less = 0.1 if kind == "departure" else 0.0
    single = rows.select(
        domain.record_key(F.lit(kind), F.col("track_id")).alias("event_id"), "site", "scene_id", F.lit(kind).alias("kind"), "track_id",
        F.round(F.greatest((domain.object_severity(F.col("cls"), F.col("length_m")) - less) * scale, F.lit(0.1)), 2).alias("severity"), F.lit(1).cast("long").alias("n"),
    )
    whole = rows.where((F.col("place") == 1) & (F.col("group_size") > INDIVIDUAL)).select(
        domain.record_key(F.lit(kind), F.lit("rollup"), F.col("site"), F.col("scene_id")).alias("event_id"), "site", "scene_id", F.lit(kind + "s").alias("kind"), F.lit(None).cast("string").alias("track_id"),
        F.round(F.least(F.lit(0.3) + F.lit(0.02) * F.col("group_size"), F.lit(0.6)) * scale, 2).alias("severity"), F.col("group_size").alias("n"),
    )
    return single.unionByName(whole)


def track_events(summary: DataFrame) -> DataFrame:
    """Fast and loitering vessels from track summaries; ``link_prob`` is the mean link probability of a track's later sightings."""
    fam = domain.family(F.col("cls"))
    fast = summary.where((fam == "vessel") & (F.col("speed_ms") > 12) & (F.coalesce("link_prob", F.lit(0.0)) >= 0.6)).select(
        domain.record_key(F.lit("fast"), F.col("track_id")).alias("event_id"), "site", "track_id", F.lit("fast_vessel").alias("kind"), F.lit(0.5).alias("severity"),
        F.round(F.col("speed_ms") * domain.KNOTS_EVENT, 1).alias("value"),
    )
    loiter = summary.where((fam == "vessel") & (F.col("dwell_days") >= 14) & (F.coalesce("speed_ms", F.lit(0.0)) < 0.3) & (F.col("n_obs") >= 3)).select(
        domain.record_key(F.lit("loiter"), F.col("track_id"), F.col("n_obs").cast("string")).alias("event_id"), "site", "track_id", F.lit("loitering").alias("kind"),
        F.round(F.lit(0.35) + F.when(F.coalesce("length_m", F.lit(0.0)) >= 150, 0.15).otherwise(0.0), 2).alias("severity"), F.col("dwell_days").alias("value"),
    )
    return fast.unionByName(loiter)


def crowded_sites(obs: DataFrame, scenes: DataFrame) -> DataFrame:
    """``site`` and ``crowded``: a median of more than 12 vessels over the clear looks that show any."""
    clear = scenes.where(clear_look(F.col("clear"))).select("scene_id")
    counts = obs.where("cls = 'vessel'").join(clear, "scene_id", "left_semi").groupBy("site", "scene_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("site").agg((F.median("n") > 12).alias("crowded"))


def baselines(obs: DataFrame, scenes: DataFrame) -> DataFrame:
    """First clear sighting of each family at a site: what comes first after it is an arrival."""
    clear = scenes.where(clear_look(F.col("clear"))).select("scene_id")
    return obs.join(clear, "scene_id", "left_semi").groupBy("site", domain.family(F.col("cls")).alias("family")).agg(F.min("time").alias("base"))


def turnover(obs: DataFrame, tracks: DataFrame, scenes: DataFrame) -> DataFrame:
    """Arrivals and departures, rolled up per scene and scaled down in crowded sites.

    ``obs`` carries ``track_id``; ``tracks`` has ``site``, ``track_id`` and ``status``.
    """
    seen = obs.where(domain.family(F.col("cls")).isin("vessel", "aircraft"))
    what = F.struct("cls", "length_m", "scene_id", "time")
    ends = seen.groupBy("site", "track_id").agg(F.min_by(what, F.struct("time", "obs_id")).alias("first"), F.max_by(what, F.struct("time", "obs_id")).alias("last"))
    crowd = crowded_sites(obs, scenes)
    first = ends.select("site", "track_id", "first.*").withColumn("family", domain.family(F.col("cls"))).join(baselines(obs, scenes), ["site", "family"]).where("time > base")
    last = ends.join(tracks.where("status = 'departed'").select("site", "track_id"), ["site", "track_id"], "left_semi").select("site", "track_id", "last.*")
    busy = F.coalesce("crowded", F.lit(False))
    return rollup(first.join(crowd, "site", "left"), "arrival", busy).unionByName(rollup(last.join(crowd, "site", "left"), "departure", busy))


def dark_vessels(obs: DataFrame, matches: DataFrame) -> DataFrame:
    """Vessels that no report explains where reports were received; ``matches`` comes from ``ais.match``."""
    dark = matches.where("dark").select("obs_id", F.col("distance_m").alias("nearest_report_m"))
    return obs.join(dark, "obs_id").select(
        domain.record_key(F.lit("dark"), F.col("obs_id").cast("string")).alias("event_id"), "site", "obs_id", F.lit("dark_vessel").alias("kind"),
        F.round(F.lit(0.55) + F.when(F.coalesce("length_m", F.lit(0.0)) >= 150, 0.25).otherwise(0.0), 2).alias("severity"), "nearest_report_m",
    )


#: A task group is a large hull with so many medium ones within reach, outside crowded sites.
GROUP_LENGTH, GROUP_MEDIUM, GROUP_REACH, GROUP_HULLS = 250.0, (100.0, 220.0), 15_000.0, 2


def task_groups(obs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Large hulls with medium hulls near them in one scene, outside crowded sites; ``obs`` carries local ``x`` and ``y``."""
    quiet = obs.where("cls = 'vessel'").join(crowded_sites(obs, scenes).where("crowded").select("site"), "site", "left_anti")
    big = quiet.where(F.col("length_m") >= GROUP_LENGTH).select("obs_id", "site", "scene_id", "x", "y", "length_m")
    medium = quiet.where(F.col("length_m").between(*GROUP_MEDIUM)).select("obs_id", "scene_id", "x", "y")
    near = range_join(big, medium, ["scene_id"], "x", "y", GROUP_REACH, F.col("l_obs_id") != F.col("r_obs_id"))
    n = near.groupBy("l_obs_id", "l_site").agg(F.count(F.lit(1)).alias("n_medium")).where(F.col("n_medium") >= GROUP_HULLS)
    return n.select(
        domain.record_key(F.lit("group"), F.col("l_obs_id").cast("string")).alias("event_id"), F.col("l_site").alias("site"), F.col("l_obs_id").alias("obs_id"),
        F.lit("possible_task_group").alias("kind"), F.lit(0.4).alias("severity"), "n_medium",
    )


EVENT = ["event_id", "site", "kind", "severity"]


def all_events(*families: DataFrame) -> DataFrame:
    """Every family's events as one frame of ``event_id``, ``site``, ``kind`` and ``severity``, one row per id."""
    rows = [f.select(*EVENT) for f in families]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole.dropDuplicates(["event_id"])
