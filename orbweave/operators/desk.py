"""Table functions of the analyst's desk: tracks, events, images, sites, investigations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import geo
from orbweave.operators import store
from orbweave.operators.windows import first_per_group
from orbweave.sources.paths import cut

#: Rows that a scan returns at most where the caller states nothing else.
TRACKS, EVENTS, IMAGES = 20_000, 500, 40
#: Words of 63 scenes that a track carries at most, parts of a scene whose pairs are one key, and tasks that share the keys.
SCENE_WORDS, SCENE_PARTS, PAIR_TASKS = 16, 8, 256
#: Detail keys that an event listing leaves out, and those that a digest keeps.
UNLISTED = ("lat", "lon", "alternatives", "track_ids", "values")
DIGEST_KEYS = ("lat", "lon", "length_m", "count", "median", "z", "dwell_days", "speed_kn", "nearest_ais_m")


def _in(box: tuple) -> Column:
    return F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])


def scan_tracks(tracks: DataFrame, site: str | None = None, status: str | None = None, box: tuple | None = None, limit: int = TRACKS) -> DataFrame:
    """Tracks by site, status and last place, last seen first."""
    for given, condition in ((site, F.col("site") == site), (status, F.col("status") == status)):
        if given is not None:
            tracks = tracks.where(condition)
    return (tracks.where(_in(box)) if box else tracks).orderBy(F.col("last_seen").desc(), "site", "track_id").limit(limit)


def get_tracks(tracks: DataFrame, box: tuple | None = None, site: str | None = None, cls: str | None = None, min_obs: int = 2, limit: int = 15) -> DataFrame:
    """The most often seen, then longest tracks, with how many match in ``total``."""
    rows = tracks.where(F.col("n_obs") >= min_obs)
    rows = rows.where(F.col("site") == site) if site else rows
    rows = rows.where(F.col("cls") == cls) if cls else rows
    rows = rows.where(_in(box)) if box else rows
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(F.col("n_obs").desc(), F.coalesce("length_m", F.lit(0.0)).desc(), "site", "track_id").limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row


def track_detail(obs: DataFrame, links: DataFrame, track: str, site: str) -> DataFrame:
    """A track's sightings in time order, each with its link probability and its rivals, likeliest first."""
    own = links.where((F.col("track_id") == track) & (F.col("site") == site) & (F.col("chosen") == 1)).select("obs_id", "prob")
    rivals = links.where((F.col("chosen") == 0) & (F.col("track_id") != track)).join(own.select("obs_id"), "obs_id", "left_semi")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), "track_id")))
    named = F.array_join(F.transform(ranked, lambda r: F.concat(r["track_id"], F.lit(":"), F.format_string("%.2f", -r["p"]))), " ")
    rivals = rivals.groupBy("obs_id").agg(named.alias("rivals"))
    return obs.join(own, "obs_id").join(rivals, "obs_id", "left").withColumn("rivals", F.coalesce("rivals", F.lit(""))).orderBy("time", "obs_id")


def scan_events(
    events: DataFrame,
    since: str | None = None,
    site: str | None = None,
    kinds: list[str] | None = None,
    least: float = 0.0,
    box: tuple | None = None,
    sites: DataFrame | None = None,
    limit: int = EVENTS,
) -> DataFrame:
    """Events by time, site, beginnings of kinds, severity and place, most severe first, then newest."""
    rows = events.where(F.col("severity") >= least)
    rows = rows.where(F.col("time") >= F.lit(since).cast(events.schema["time"].dataType)) if since else rows
    rows = rows.where(F.col("site") == site) if site else rows
    rows = store.located_events(rows, sites, box) if box else rows
    if kinds:
        begins = F.lit(False)
        for k in kinds:
            begins = begins | F.startswith("kind", F.lit(k))
        rows = rows.where(begins)
    return rows.orderBy(F.col("severity").desc(), F.col("time").desc(), "event_id").limit(limit)


def without_keys(detail: Column, keys: tuple[str, ...] = UNLISTED) -> Column:
    return F.map_filter(detail, lambda k, v: ~k.isin(*keys))


def only_keys(detail: Column, keys: tuple[str, ...] = DIGEST_KEYS) -> Column:
    return F.map_filter(detail, lambda k, v: k.isin(*keys))


def image_search(scenes: DataFrame, area: tuple, since: str, until: str, max_cloud: float = 100.0, least: float = 0.3, limit: int = IMAGES) -> DataFrame:
    """Images of the area in a window, newest first, with their share of the area."""
    box = tuple(F.lit(float(v)) for v in area)
    kind = scenes.schema["time"].dataType
    share = F.round(geo.overlap_share(box, (F.col("w"), F.col("s"), F.col("e"), F.col("n_lat"))), 3)
    rows = scenes.where(F.col("time").between(F.lit(since).cast(kind), F.lit(until).cast(kind)) & (F.coalesce("cloud", F.lit(0.0)) <= max_cloud))
    return rows.withColumn("coverage", share).where(F.col("coverage") >= least).orderBy(F.col("time").desc(), "scene_id").limit(limit)


def image_summary(images: DataFrame) -> DataFrame:
    """Images of a search by source, most first, with the newest day."""
    return images.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("time"), "yyyy-MM-dd").alias("newest")).orderBy(F.col("n").desc(), "source")


def captures(rows: DataFrame, limit: int = 30) -> DataFrame:
    """Distinct captures (by captured, sensor, resolution; by release where the capture is unknown), newest release first."""
    known = F.when(F.col("captured").isNotNull(), F.concat_ws("|", F.col("captured").cast("string"), F.coalesce("sensor", F.lit("")), F.coalesce(F.col("resolution").cast("string"), F.lit(""))))
    keyed = rows.withColumn("_key", F.coalesce(known, F.concat(F.lit("release|"), F.col("release").cast("string"))))
    return first_per_group(keyed, ["_key"], [F.col("release_date").desc(), F.col("release").desc()]).drop("_key").orderBy(F.col("release_date").desc(), F.col("release").desc()).limit(limit)


def list_sites(sites: DataFrame, obs: DataFrame, events: DataFrame, since: str) -> DataFrame:
    """Sites with their number of observations and the largest severity since a date, 0 without any."""
    kind = events.schema["time"].dataType
    counts = obs.groupBy("site").agg(F.count(F.lit(1)).alias("observations"))
    top = events.where(F.col("time") >= F.lit(since).cast(kind)).groupBy("site").agg(F.max("severity").alias("max_severity"))
    rows = sites.select("site", "kind", "w", "s", "e", "n").join(counts, "site", "left").join(top, "site", "left")
    return rows.withColumn("observations", F.coalesce("observations", F.lit(0)).cast("long")).withColumn("max_severity", F.coalesce("max_severity", F.lit(0.0)))


def unknown_names(asked: list[str], known: list[str]) -> list[str]:
    """Names asked for that nothing has, in the order asked."""
    return [n for n in dict.fromkeys(asked) if n not in set(known)]


# ------------------------------------------------------------------ store actions


def delete_site(sites: DataFrame, site: str) -> tuple[DataFrame, bool]:
    """The table without the site, and whether it had it."""
    return sites.where(~F.col("site").eqNullSafe(F.lit(site))), sites.where(F.col("site") == site).limit(1).count() > 0


def unprocessed(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """(site, scene_id, detector) rows of which no run has ended well: failed runs are tried again."""
    return wanted.join(runs.where("status = 'ok'").select("site", "scene_id", "detector"), ["site", "scene_id", "detector"], "left_anti")


def record_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs by (site, scene, detector), the latest in place of older ones."""
    return store.upsert(runs, new, ["site", "scene_id", "detector"], "finished")


def add_events(events: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with what it lacks of ``new``, and those rows; severity is 0.5 and the detail empty where they are not given."""
    filled = new.withColumn("severity", F.coalesce("severity", F.lit(0.5)))
    if "detail" in new.columns:
        filled = filled.withColumn("detail", F.coalesce("detail", F.create_map().cast(new.schema["detail"].dataType)))
    fresh = store.insert_ignore(events, filled.select(*events.columns), ["event_id"])
    return events.unionByName(fresh), fresh


def save_investigations(table: DataFrame, new: DataFrame) -> DataFrame:
    """Investigations by id, new ones in place of old; all but the key columns goes into a JSON tail."""
    tail = F.to_json(F.struct(*[c for c in new.columns if c not in ("id", "question", "started")]))
    return store.upsert(table, new.select("id", "question", "started", tail.alias("body")), ["id"], "started")


def investigations(table: DataFrame, latest: int = 20) -> DataFrame:
    return table.orderBy(F.col("started").desc(), "id").limit(latest)


def save_tracking(links: DataFrame, new: DataFrame, sites: list[str]) -> DataFrame:
    """The links table after whole sites are linked anew: their old links go, those of others stay."""
    return links.where(~F.coalesce(F.col("site").isin(*sites), F.lit(False))).unionByName(new)


# ------------------------------------------------------------------ lookups and reports


def pairs_seen_together(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, scene_id) of a left and a right track of one scene, with the number of distinct scenes that show both, on every row.

    Both sides are distinct (scene_id, track_id); a scene that has b on the left and a on the right counts as well. Without
    a right side the tracks meet each other, and two of them make one row, a being the smaller, in the first of their
    scenes. Every track carries its scenes to the join, as bits while there are few and as a sorted array
    otherwise, so pairs are counted where they meet and never shuffled.
    """
    once = right is None
    right = left if once else right
    scenes = left.select("scene_id").union(right.select("scene_id")).where("scene_id is not null").distinct()
    few = scenes.limit(63 * SCENE_WORDS + 1).count()
    rows = left.select("scene_id", "track_id", F.lit(True).alias("_l")).unionByName(right.select("scene_id", "track_id", F.lit(False).alias("_l"))).where("scene_id is not null and track_id is not null")
    if few <= 63 * SCENE_WORDS:
        words = range(max(1, -(-few // 63)))
        number = F.row_number().over(Window.orderBy("scene_id")) - 1  # a bounded number of scenes
        numbered = cut(scenes.withColumn("_n", number).select("scene_id", (F.col("_n") / 63).cast("int").alias("_w"), F.expr("shiftleft(1L, cast(_n % 63 as int))").alias("_bit")))
        rows = rows.join(F.broadcast(numbered), "scene_id")
        bits = lambda k, side: F.coalesce(F.bit_or(F.when((F.col("_w") == k) & (F.col("_l") == side), F.col("_bit"))), F.lit(0).cast("long"))
        shown = rows.groupBy("track_id").agg(*[bits(k, True).alias(f"l{k}") for k in words], *[bits(k, False).alias(f"r{k}") for k in words])
        shared = [F.col(f"a_l{k}").bitwiseAND(F.col(f"b_r{k}")).bitwiseOR(F.col(f"a_r{k}").bitwiseAND(F.col(f"b_l{k}"))) for k in words]
        together = sum((F.bit_count(x) for x in shared[1:]), F.bit_count(shared[0]))
        # Bits of the scenes before a row's own: the pair's first scene has none of them.
        before = [F.when(F.col("_w") > k, F.lit(-1).cast("long")).when(F.col("_w") == k, F.col("_bit") - 1).otherwise(F.lit(0).cast("long")) for k in words]
        first = F.lit(True)
        for k, x in zip(words, shared, strict=True):
            first = first & (x.bitwiseAND(F.col(f"a_m{k}")) == 0)
        dress = lambda side: side.join(F.broadcast(numbered), "scene_id").select("scene_id", "track_id", *[m.alias(f"m{k}") for k, m in zip(words, before, strict=True)]).join(shown, "track_id")
    else:
        listed = lambda side: F.array_sort(F.collect_set(F.when(F.col("_l") == side, F.col("scene_id"))))
        shown = rows.groupBy("track_id").agg(listed(True).alias("l"), listed(False).alias("r"))
        met = F.array_intersect("a_l", "b_r")
        met = met if once else F.array_union(met, F.array_intersect("a_r", "b_l"))
        together, first = F.size(met), F.get(met, F.lit(0)) == F.col("scene_id")
        dress = lambda side: side.select("scene_id", "track_id").join(shown, "track_id")
    named = lambda rows, p: rows.select("scene_id", "_p", *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in ("scene_id", "_p")])
    # A scene's pairs are many though its rows are few: its left tracks are dealt out and all right ones meet each part.
    a = named(dress(left).withColumn("_p", F.pmod(F.xxhash64("track_id"), F.lit(SCENE_PARTS)).cast("int")), "a")
    b = named(dress(right).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(SCENE_PARTS - 1)))), "b")
    b = b.drop(*[c for c in b.columns if c.startswith("b_m")])
    pairs = a.repartition(PAIR_TASKS, "scene_id", "_p").join(b.repartition(PAIR_TASKS, "scene_id", "_p").hint("merge"), ["scene_id", "_p"])
    if once:
        pairs = pairs.where((F.col("a_track_id") < F.col("b_track_id")) & first)
    return pairs.select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), "scene_id", together.cast("long").alias("scenes_together"))


def citation_report(answers: DataFrame, evidence: DataFrame, cited: Column) -> DataFrame:
    """Per answer: cited ids in order, those nothing backs, evidence not cited, and cited ids by kind.

    ``answers`` has ``id``; ``evidence`` has ``id``, ``evidence`` and ``kind``. Kinds come as ``kind:n``, sorted.
    """
    rows = answers.select("id", cited.alias("cited"))
    held = evidence.groupBy("id").agg(F.array_sort(F.collect_set("evidence")).alias("held"))
    kinds = (
        rows.select("id", F.explode("cited").alias("evidence")).join(evidence.dropDuplicates(["id", "evidence"]), ["id", "evidence"]).groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit(":"), F.col("n").cast("string")))), ",").alias("by_kind"))
    )
    none = F.array().cast("array<string>")
    whole = rows.join(held, "id", "left").join(kinds, "id", "left").withColumn("held", F.coalesce("held", none))
    return whole.select("id", F.array_join("cited", ",").alias("cited"), F.array_join(F.array_except("cited", "held"), ",").alias("unknown"), F.array_join(F.array_except("held", "cited"), ",").alias("uncited"), F.coalesce("by_kind", F.lit("")).alias("by_kind"))


def longest_first(rows: DataFrame, keep: int, by: str, text: str) -> DataFrame:
    """Rows of a result cut to ``keep`` characters in all: the longest texts stay out first."""
    size = F.sum(F.char_length(text)).over(Window.partitionBy(by).orderBy(F.char_length(text), text).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_size", size).where(F.col("_size") <= keep).drop("_size")
