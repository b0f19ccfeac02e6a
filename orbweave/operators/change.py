"""Change regions: morphology on cell tables, regions and their figures, image pairs, events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.raster import region_confidence, regions
from orbweave.operators.windows import first_per_group
from orbweave.sources.paths import cut

# Cover classes that hide the ground, and how far around them pixels are doubted.
CLOUD_CLASSES, CLOUD_RIM = (0, 1, 3, 8, 9, 10, 11), 3
# Smallest region, most regions, events per image and their least confidence.
MIN_AREA_M2, MAX_REGIONS, MAX_EVENTS, EVENT_CONFIDENCE = 1500.0, 300, 25, 0.35
# Ships that lie in changed water are small and long.
SHIP_AREA_M2, SHIP_RATIO = 30_000.0, 3.0
WATER_KINDS = ("new_water", "water_loss")


def _diamond(n: int) -> Column:
    """Steps of at most ``n`` moves along rows and columns."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-n, n + 1) for j in range(-n, n + 1) if abs(i) + abs(j) <= n])


def dilated(cells: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """Cells within ``n`` moves of a cell of the set; ``by`` separates images or kinds."""
    return cells.select(*by, "row", "col", F.explode(_diamond(n)).alias("_d")).select(*by, (F.col("row") + F.col("_d.i")).alias("row"), (F.col("col") + F.col("_d.j")).alias("col")).distinct()


def eroded(cells: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """Cells whose every neighbour within ``n`` moves is in the set; beyond the image nothing is."""
    whole = 2 * n * n + 2 * n + 1
    around = cells.select(*by, "row", "col").distinct().select(*by, "row", "col", F.explode(_diamond(n)).alias("_d"))
    return around.groupBy(*by, (F.col("row") + F.col("_d.i")).alias("row"), (F.col("col") + F.col("_d.j")).alias("col")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == whole).drop("_n")


def opened(cells: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """Erosion, then dilation: what is thinner than the diamond goes."""
    return dilated(eroded(cells, by, n), by, n)


def clear_pixels(pixels: DataFrame, cover: str, by: list[str] | None = None, rim: int = CLOUD_RIM) -> DataFrame:
    """``pixels`` with ``clear``: a cover class is known and no cloud or shadow lies within ``rim`` moves."""
    by = by or []
    bad = pixels.where(F.coalesce(F.col(cover), F.lit(0)).isin(*CLOUD_CLASSES)).select(*by, "row", "col")
    near = dilated(bad, by, rim).withColumn("_bad", F.lit(True))
    return pixels.join(near, [*by, "row", "col"], "left").withColumn("clear", F.col("_bad").isNull() & F.col(cover).isNotNull()).drop("_bad")


def ship_shaped(area: Column, n: Column, vr: Column, vc: Column, rc: Column) -> Column:
    """Small and long (or a line): a moored or passing ship rather than a change of the water. Sample variances of rows and columns."""
    half, root = (vr + vc) / 2, F.sqrt(F.pow((vr - vc) / 2, 2) + rc * rc)
    low, high = half - root, half + root
    return (area <= SHIP_AREA_M2) & (n >= 3) & ((low <= 1e-9) | (F.sqrt(high / F.when(low > 1e-9, low)) >= SHIP_RATIO))


def change_regions(pixels: DataFrame, k: float, res: float, n_base: int, values: dict[str, tuple[str, str]] | None = None, least_m2: float = MIN_AREA_M2, most: int = MAX_REGIONS) -> DataFrame:
    """Regions of pixels with a ``kind`` and a ``score``, largest times surest first.

    Kinds are opened (at fine resolution), labelled by four-neighbourhood and dropped if small, or if ship-shaped in
    water. ``values`` names columns before and after whose medians over a region are returned as ``<name>_b`` and ``<name>_a``.
    """
    kinds = cut(pixels.where("kind is not null"))
    cells = kinds.select("kind", "row", "col")
    labels = regions(opened(cells, ["kind"]) if res <= 12 else cells, ["kind"])
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    medians = [F.median(col).alias(f"{n}_{side}") for n, cols in (values or {}).items() for side, col in zip("ba", cols, strict=True)]
    found = labels.join(kinds, ["kind", "row", "col"]).groupBy("kind", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.avg(r).alias("row"), F.avg(c).alias("col"),
        F.var_samp(r).alias("_vr"), F.var_samp(c).alias("_vc"), F.covar_samp(r, c).alias("_rc"), *medians,
    )
    found = found.withColumn("area_m2", F.col("n") * res * res).where(F.col("n") >= max(2, round(least_m2 / (res * res))))
    ship = F.col("kind").isin(*WATER_KINDS) & ship_shaped(F.col("area_m2"), F.col("n"), F.col("_vr"), F.col("_vc"), F.col("_rc"))
    sure = region_confidence(F.col("score"), k, F.col("area_m2"), least_m2, n_base)
    kept = found.where(~F.coalesce(ship, F.lit(False))).withColumn("confidence", sure).drop("_vr", "_vc", "_rc")
    return kept.orderBy((F.col("area_m2") * F.col("confidence")).desc(), "kind", "label").limit(most)


def by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("regions"), F.round(F.sum("area_m2"), 0).alias("area_m2"))


def region_events(found: DataFrame, site: Column, scene: Column) -> DataFrame:
    """Sure enough regions as events of a site, which its refreshes keep."""
    sure = found.where(F.col("confidence") >= EVENT_CONFIDENCE).orderBy((F.col("area_m2") * F.col("confidence")).desc(), "kind", "label").limit(MAX_EVENTS)
    raw = F.lit(0.25) + F.lit(0.35) * F.col("confidence") + F.lit(0.05) * F.least(F.log10(F.greatest("area_m2", F.lit(1.0))) - 3, F.lit(2.0))
    key = F.substring(F.sha1(F.concat_ws("|", F.lit("change"), site, scene, "kind", "label").cast("binary")), 1, 16)
    return sure.select(key.alias("event_id"), site.alias("site"), F.concat(F.lit("change_"), "kind").alias("kind"), F.round(F.least(raw, F.lit(0.8)), 2).alias("severity"), "area_m2")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex outline of points, counter-clockwise from the smallest."""
    points = sorted(set(points))
    if len(points) < 3:
        return []

    def side(order: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    corners = side(points) + side(points[::-1])
    return corners if len(corners) > 2 else []


def outlines(labels: DataFrame, by: list[str]) -> DataFrame:
    """Convex outlines of labelled regions as arrays of (x, y), empty for lines. Only the ends of a region's rows leave the shuffle."""
    ends = labels.groupBy(*by, "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    point = lambda c: F.struct(F.col(c).cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    rows = ends.groupBy(*by).agg(F.collect_list(F.array(point("lo"), point("hi"))).alias("points")).withColumn("points", F.flatten("points"))
    kinds = dict(rows.dtypes)
    made = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"x": x, "y": y} for x, y in hull([(p["x"], p["y"]) for p in own])] for own in batch.column("points").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], pa.array(found, type=made)], names=[*by, "outline"])

    return rows.select(*by, "points").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", outline array<struct<x:double,y:double>>")


def pick_scenes(scenes: DataFrame, source: str, now: str, after: str | None = None, before: str | None = None, lookback_days: int = 90, baseline: str = "recent", least: float = 0.7) -> DataFrame:
    """Candidates for a change pair: ``role`` (after, before) and ``place`` in it, newest first.

    The image after lies within 30 days of now, or 3 of a stated day; the baseline ends 4 days before the newest of
    these (or on a stated day) and goes back ``lookback_days``, or lies around the same day a year earlier. Radar
    images of the same orbit come first.
    """
    if source not in ("sentinel-2", "sentinel-1"):
        raise ValueError("change detection supports sentinel-2 and sentinel-1")
    kind = scenes.schema["time"].dataType
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    days = lambda n: F.expr(f"interval {n} days")
    usable = scenes.where((F.col("source") == source) & (F.coalesce("coverage", F.lit(1.0)) >= least))
    usable = usable.where(F.coalesce("cloud", F.lit(0.0)) <= 60.0) if source == "sentinel-2" else usable
    end = at(after) + days(1) if after else at(now)
    time = F.col("time").cast("timestamp_ntz")
    afters = usable.where(time.between(end - days(3 if after else 30), end))
    newest = F.struct("time", "scene_id")
    ref = afters.agg(F.max("time").alias("ref"), F.max_by("orbit", newest).alias("ref_orbit"))  # one row
    rows = usable.crossJoin(F.broadcast(ref)).where("ref is not null")
    ref_at = F.col("ref").cast("timestamp_ntz")
    if baseline == "anniversary":
        last = (at(before) if before else ref_at - days(365)) + days(30)
        first = last - days(60)
    else:
        last = at(before) + days(1) if before else ref_at - days(4)
        first = last - days(lookback_days)
    befores = rows.where(time.between(first, last) & (time < ref_at - F.expr("interval 12 hours")))
    same = (F.col("orbit").eqNullSafe(F.col("ref_orbit"))).cast("int") if source == "sentinel-1" else F.lit(0)
    one = lambda frame, role, order: _placed(frame.select("scene_id", F.col("time").cast(kind).alias("time"), order.alias("_same")), role)
    return one(rows.where(time.between(end - days(3 if after else 30), end)), "after", F.lit(0)).unionByName(one(befores, "before", same))


def _placed(rows: DataFrame, role: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy(F.col("_same").desc(), F.col("time").desc(), "scene_id")  # the few candidates of one area
    return rows.select(F.lit(role).alias("role"), F.row_number().over(w).alias("place"), "scene_id")


def choose_images(candidates: DataFrame, n_before: int = 3, least: float = 0.3) -> DataFrame:
    """Of candidates with their ``valid`` share: the first clear one of three after, and the first ``n_before`` clear ones of twice as many before."""
    after = candidates.where((F.col("role") == "after") & (F.col("place") <= 3) & (F.col("valid") >= least))
    before = candidates.where((F.col("role") == "before") & (F.col("place") <= 2 * n_before) & (F.col("valid") >= least))
    return first_per_group(after, ["role"], [F.col("place")]).unionByName(first_per_group(before, ["role"], [F.col("place")], n_before))


def frame_accepted(pixels: DataFrame, by: list[str], bands: list[str], bright: float = 200.0) -> DataFrame:
    """Timelapse frames with at least 80 % valid pixels of which not more than half are bright in every band."""
    valid = F.lit(True)
    for b in bands:
        valid = valid & F.col(b).isNotNull()
    white = valid & (F.least(*bands) > bright) if len(bands) > 1 else valid & (F.col(bands[0]) > bright)
    found = pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid"), F.count_if(F.coalesce(white, F.lit(False))).alias("bright"))
    return found.where((F.col("valid") >= 0.8 * F.col("n")) & (F.col("bright") <= 0.5 * F.col("valid")))


def stretched(value: Column, low: float, high: float, gamma: float = 1.4) -> Column:
    """Reflectance as a byte of a picture."""
    share = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.floor(F.pow(share, F.lit(1 / gamma)) * 255), F.lit(0)).cast("int")


def grid_of(w: Column, s: Column, e: Column, n: Column, res: float, most: int) -> tuple[Column, Column, Column]:
    """Resolution, width and height of an area's pixel grid; the resolution rises until no side has more than ``most`` pixels."""
    from orbweave.functions.geo import size_km

    wide, high = (v * 1000 for v in size_km(w, s, e, n))
    step = F.greatest(F.lit(float(res)), F.greatest(wide, high) / most)
    side = lambda v: F.greatest(F.lit(1), F.bround(v / step, 0).cast("int"))
    return step, side(wide), side(high)
