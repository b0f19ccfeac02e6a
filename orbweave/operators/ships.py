"""Ships on pixels: masks, contrast against a smoothed sea, blobs and their figures, wakes.

An image is a table of pixels (row, col and bands); everything is a join or an aggregation over cells, so an
image need not fit a task and there are no tile seams to mend. Smoothing works on strips of lines.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.change import dilated, opened
from orbweave.operators.medians import medians
from orbweave.operators.raster import block_median, hull_like, otsu, regions
from orbweave.operators.windows import MAD
from orbweave.sources.paths import cut

# Cover classes, vegetation index, sizes of clouds and holes in pixels, hull lengths in metres.
SCL_WATER, SCL_PLANT, SCL_CLOUD = 6, 4, (3, 8, 9, 10)
PLANT_INDEX, CLOUD_PX, CLOUD_GROWTH, HOLE_PX, PLANT_SHARE = 0.55, 400, 4, 400, 0.2
MAX_HULL_M, CLUTTER = 520.0, 3000
#: Pixels of one strip of a line, and of a side of the tiles that wakes are looked for in.
STRIP, TILE = 1024, 64


# ------------------------------------------------------------------ smoothing


def _smoothed_lines(rows: DataFrame, by: list[str], along: str, across: str, columns: list[str], kernel: np.ndarray, size: int) -> DataFrame:
    reach = len(kernel) // 2
    strip = max(STRIP, 2 * reach)
    p = F.col(along)
    images = F.filter(F.array(p, -p - 1, F.lit(2 * size - 1) - p), lambda x: (x >= -reach) & (x < size + reach))
    near = lambda x: F.sequence(F.floor(F.greatest(x - reach, F.lit(0)) / strip), F.floor(F.least(x + reach, F.lit(size - 1)) / strip))
    spread = rows.select(*by, F.explode(images).alias("_p"), F.col(across), *columns).withColumn("_k", F.explode(near(F.col("_p"))))

    def run(key, table):
        line, k = key[-2].as_py(), key[-1].as_py()
        begin, n = k * strip, min(strip, size - k * strip)
        at = table.column("_p").to_numpy() - (begin - reach)
        inside = (at >= 0) & (at < n + 2 * reach)
        out = []
        for c in columns:
            dense = np.zeros(n + 2 * reach)
            dense[at[inside]] = table.column(c).to_numpy()[inside]
            out.append(pa.array(np.convolve(dense, kernel, "valid")))
        same = [pa.array([v.as_py()] * n, type=v.type) for v in key[:-2]]
        return pa.table([*same, pa.array(np.arange(begin, begin + n)), pa.array(np.full(n, line)), *out], names=[*by, along, across, *columns])

    kinds = [f"{c} {t}" for c, t in rows.dtypes if c in by] + [f"{along} long", f"{across} long"] + [f"{c} double" for c in columns]
    return spread.groupBy(*by, across, "_k").applyInArrow(run, ", ".join(kinds))


def gaussian(sigma: float) -> np.ndarray:
    """Weights of a Gaussian mean, cut at four deviations."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return kernel / kernel.sum()


def smoothed(pixels: DataFrame, columns: list[str], sigma: float, height: int, width: int, by: list[str] = ()) -> DataFrame:
    """Gaussian means of the columns (cut at four deviations, edges mirrored) at every pixel of the lines that have any; absent pixels count as 0. ``by`` separates images."""
    by, kernel = list(by), gaussian(sigma)
    rows = pixels.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.col(c).cast("double").alias(c) for c in columns])
    return _smoothed_lines(_smoothed_lines(rows, by, "row", "col", columns, kernel, height), by, "col", "row", columns, kernel, width)


# ------------------------------------------------------------------ masks


def small_holes(pixels: DataFrame, mask: str, evidence: str, height: int, width: int, most: int = HOLE_PX, share: float = PLANT_SHARE) -> DataFrame:
    """Cells (row, col) of specks that the mask encloses: small ones of which little is known to be land."""
    labels = regions(pixels.where(~F.col(mask)).select("row", "col"), [])
    cells = labels.join(pixels.select("row", "col", evidence), ["row", "col"])
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    good = cells.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(edge).alias("edge"), F.count_if(F.col(evidence)).alias("land"))
    good = good.where((F.col("edge") == 0) & (F.col("n") <= most) & (F.col("land") <= share * F.col("n")))
    return labels.join(good.select("label"), "label", "left_semi").select("row", "col")


def optical_masks(pixels: DataFrame, height: int, width: int, plant: float = PLANT_INDEX, cloud_px: int = CLOUD_PX, growth: int = CLOUD_GROWTH, hole_px: int = HOLE_PX) -> DataFrame:
    """``pixels`` (nir, green, red, scl) with ``sea``, ``cloud`` and ``land``.

    Water is a cover class or, without one, a positive water index; specks in it are candidate hulls and
    join it. Bright ships are often classed as cloud, so only large clouds count, and their rim.
    """
    nd = lambda a, b: F.coalesce(F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b)), F.lit(0.0))
    water = F.when(F.col("scl").isNotNull(), F.col("scl") == SCL_WATER).otherwise(nd("green", "nir") > 0)
    rows = cut(pixels.withColumn("_water", water).withColumn("_plant", (nd("nir", "red") > plant) | F.coalesce(F.col("scl") == SCL_PLANT, F.lit(False))))
    clouds = regions(rows.where(F.col("scl").isin(*SCL_CLOUD)).select("row", "col"), [])
    big = clouds.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cloud_px)
    cloud = dilated(clouds.join(big, "label", "left_semi"), [], growth).withColumn("_cloud", F.lit(True))
    holes = small_holes(rows, "_water", "_plant", height, width, hole_px).withColumn("_hole", F.lit(True))
    rows = rows.join(cloud, ["row", "col"], "left").join(holes, ["row", "col"], "left")
    valid, is_cloud = F.col("nir").isNotNull(), F.coalesce("_cloud", F.lit(False))
    sea = F.col("_water") | F.coalesce("_hole", F.lit(False))
    return rows.withColumn("sea", sea & valid & ~is_cloud).withColumn("cloud", is_cloud).withColumn("land", valid & ~sea & ~is_cloud).drop("_water", "_plant", "_cloud", "_hole")


def radar_water(pixels: DataFrame, db: str, factor: int, calibrated: bool, least_separation: float = 5.0) -> DataFrame:
    """Water cells (row, col) by a threshold between the two classes of the coarse backscatter.

    Without a clear separation it is -14 dB for calibrated images, and everything is water in others.
    """
    coarse = cut(block_median(pixels.where(F.col(db).isNotNull()), db, factor))
    t = otsu(coarse, db).first()
    if t is None or t["separation"] is None or t["separation"] < least_separation:
        threshold = -14.0 if calibrated else math.inf
    else:
        threshold = t["threshold"]
    wet = opened(coarse.where(F.col(db) < threshold).select("row", "col"), []).select(F.col("row").alias("_r"), F.col("col").alias("_c"))
    block = lambda c: F.floor(F.col(c) / factor)
    return pixels.join(wet, (block("row") == F.col("_r")) & (block("col") == F.col("_c")), "left_semi").where(F.col(db).isNotNull()).select("row", "col")


# ------------------------------------------------------------------ targets


def contrasted(pixels: DataFrame, value: str, sigma_m: float, res: float, height: int, width: int) -> DataFrame:
    """``pixels`` (sea, value) with ``excess`` over the smoothed sea and its deviation ``std``."""
    rows = cut(pixels)
    sea = F.col("sea") & F.col(value).isNotNull()
    med, n = medians(rows, {"v": F.when(sea, F.col(value))})["v"]
    if not n:
        return rows.withColumn("excess", F.lit(0.0)).withColumn("std", F.lit(1.0))
    mad = medians(rows, {"v": F.when(sea, F.abs(F.col(value) - F.lit(med)))})["v"][0] * MAD + 1e-9
    clipped = F.when(F.col("sea"), F.least(F.coalesce(F.col(value), F.lit(med)), F.lit(med + 3 * mad))).otherwise(0.0)
    parts = rows.select("row", "col", F.col("sea").cast("double").alias("_w"), clipped.alias("_v"), (clipped * clipped).alias("_vv"))
    sigma = min(max(sigma_m / res, 6.0), 80.0)
    wide = smoothed(parts, ["_w", "_v", "_vv"], sigma, height, width)
    weight = F.col("_w") + F.lit(1e-6)
    mean = F.col("_v") / weight
    return (
        rows.join(wide, ["row", "col"])
        .withColumn("_m", mean)
        .withColumn("std", F.sqrt(F.greatest(F.col("_vv") / weight - F.col("_m") * F.col("_m"), F.lit((0.5 * mad) ** 2))))
        .withColumn("excess", F.coalesce(F.col(value) - F.col("_m"), F.lit(0.0)))
        .drop("_w", "_v", "_vv", "_m")
    )


def targets(contrast: DataFrame, k: float, least: float) -> DataFrame:
    """Cells that stand out of the sea, with the ``label`` of their blob (eight neighbours)."""
    hot = cut(contrast.where(F.col("sea") & (F.col("excess") > k * F.col("std")) & (F.col("excess") > least)))
    return cut(regions(hot.select("row", "col"), [], diagonal=True).join(hot, ["row", "col"]))


def blobs(cells: DataFrame, masks: DataFrame, res: float, least_m2: float, shore: int) -> DataFrame:
    """Length, width, heading, area, peak contrast, wiggle and nearness to land of every blob that is large enough."""
    r, c = F.col("row").cast("double") * res, F.col("col").cast("double") * res
    near = dilated(masks.where("land or cloud").select("row", "col"), [], shore).withColumn("_near", F.lit(True))
    m = cells.join(near, ["row", "col"], "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("row").alias("row"), F.avg("col").alias("col"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias("_xx"), F.coalesce(F.var_samp(r), F.lit(0.0)).alias("_yy"),
        F.coalesce(F.covar_samp(c, r), F.lit(0.0)).alias("_xy"), F.round(F.max(F.col("excess") / F.col("std")), 1).alias("contrast"), F.coalesce(F.bool_or("_near"), F.lit(False)).alias("near_shore"),
    )
    m = m.where(F.col("n") >= max(2, math.ceil(least_m2 / (res * res))))
    half, root = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt(F.pow((F.col("_xx") - F.col("_yy")) / 2, 2) + F.col("_xy") * F.col("_xy"))
    turn = F.lit(0.5) * F.atan2(F.col("_xy") * 2, F.col("_xx") - F.col("_yy"))
    side = lambda v: F.greatest(F.sqrt(F.lit(12.0) * F.greatest(v, F.lit(0.0))), F.lit(float(res)))
    m = m.withColumn("_ux", F.cos(turn)).withColumn("_uy", F.sin(turn)).withColumn("length_m", F.round(side(half + root), 1)).withColumn("width_m", F.round(side(half - root), 1))
    m = cut(m.withColumn("heading_deg", F.round(F.pmod(F.degrees(F.atan2("_ux", -F.col("_uy"))), F.lit(180.0)), 1)).withColumn("area_m2", F.round(F.col("n") * res * res, 1)))
    axis = m.where("n >= 8").select("label", F.col("row").alias("_r"), F.col("col").alias("_c"), "_ux", "_uy")
    dx, dy = (F.col("col") - F.col("_c")) * res, (F.col("row") - F.col("_r")) * res
    spine = cells.join(axis, "label").select("label", (dx * F.col("_ux") + dy * F.col("_uy")).alias("a"), (dy * F.col("_ux") - dx * F.col("_uy")).alias("x"))
    ends = spine.groupBy("label").agg(F.min("a").alias("a0"))
    slices = spine.join(ends, "label").groupBy("label", F.floor((F.round("a", 6) - F.round("a0", 6)) / (2 * res)).alias("b")).agg(F.avg("x").alias("x"))
    wiggle = slices.groupBy("label").agg(F.when(F.count(F.lit(1)) >= 3, F.sqrt(F.avg(F.col("x") * F.col("x")))).otherwise(0.0).alias("w"))
    return m.join(wiggle, "label", "left").withColumn("wiggle_m", F.round(F.coalesce("w", F.lit(0.0)), 1)).drop("w", "_xx", "_yy", "_xy", "_ux", "_uy")


def ring_excess(cells: DataFrame, pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Per blob and band its mean less the median of the water two to four moves around it; null without such water."""
    inner = dilated(cells.select("label", "row", "col"), ["label"], 1)
    ring = dilated(cells.select("label", "row", "col"), ["label"], 4).join(inner, ["label", "row", "col"], "left_anti").join(pixels.where("sea").select("row", "col", *bands), ["row", "col"])
    around = ring.groupBy("label").agg(*[F.median(b).alias(f"_{b}") for b in bands])
    own = cells.select("label", "row", "col").join(pixels.select("row", "col", *bands), ["row", "col"]).groupBy("label").agg(*[F.avg(b).alias(b) for b in bands])
    return own.join(around, "label", "left").select("label", *[F.round(F.col(b) - F.col(f"_{b}"), 4).alias(b) for b in bands])


def wakes(found: DataFrame, cells: DataFrame, pixels: DataFrame, res: float, least_m: float = 30.0) -> DataFrame:
    """``label``, ``underway``, ``course_deg`` and ``wake_m`` from foam ahead of and behind a hull.

    Foam is brighter than the water in blue and bluer than in near infrared, in a corridor along the
    axis up to three lengths past the hull; much more of it behind than ahead tells the course. Hulls
    meet the pixels of their window by tiles.
    """
    long = found.where((F.col("length_m") >= least_m) & (F.col("n") >= 3))
    box = cells.groupBy("label").agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    pad = (F.ceil(F.lit(3.5) * F.col("length_m") / res) + 4).cast("long")
    hulls = long.join(box, "label").select("label", F.col("row").alias("_r"), F.col("col").alias("_c"), "length_m", "width_m", "heading_deg", *[(F.col(c) + s * pad).alias(c) for c, s in (("_r0", -1), ("_r1", 1), ("_c0", -1), ("_c1", 1))])
    tiles = lambda a, b: F.sequence(F.floor(F.col(a) / TILE), F.floor(F.col(b) / TILE))
    hulls = hulls.withColumn("_tr", F.explode(tiles("_r0", "_r1"))).withColumn("_tc", F.explode(tiles("_c0", "_c1")))
    marks = cells.select("row", "col", F.col("label").alias("_own"))
    close = dilated(cells.select("row", "col"), [], 3).withColumn("_close", F.lit(True))
    sea = pixels.select("row", "col", "sea", "blue", "nir").join(marks, ["row", "col"], "left").join(close, ["row", "col"], "left")
    sea = sea.withColumn("_tr", F.floor(F.col("row") / TILE)).withColumn("_tc", F.floor(F.col("col") / TILE))
    window = sea.join(hulls, ["_tr", "_tc"]).where("row between _r0 and _r1 and col between _c0 and _c1")
    hull_rim = dilated(cells.select("label", "row", "col"), ["label"], 1).withColumn("_rim", F.lit(True))
    window = cut(window.join(hull_rim, ["label", "row", "col"], "left").drop("_tr", "_tc"))
    water = window.where("sea and _close is null")
    level = water.groupBy("label").agg(F.median("blue").alias("b0"), F.median("nir").alias("n0"))
    noise = water.join(level, "label").groupBy("label", "b0", "n0").agg((F.median(F.abs(F.col("blue") - F.col("b0"))) * MAD + 1e-4).alias("sd"))
    a = F.radians("heading_deg")
    east, north = (F.col("col") - F.col("_c")) * res, -(F.col("row") - F.col("_r")) * res
    along, across = east * F.sin(a) + north * F.cos(a), north * F.sin(a) - east * F.cos(a)
    seen = window.join(noise, "label").withColumn("along", along).withColumn("across", across)
    free = F.col("_own").isNull() | (F.col("_own") == F.col("label"))
    corridor = (F.abs("across") <= F.greatest("width_m", F.lit(2.0 * res))) & (F.abs("along") <= F.lit(3.5) * F.col("length_m"))
    foam = free & corridor & F.col("_rim").isNull() & (F.col("blue") - F.col("b0") > F.col("sd") * 3) & (F.col("blue") - F.col("b0") > F.coalesce(F.col("nir") - F.col("n0"), F.lit(0.0)))
    foam, half = F.coalesce(foam, F.lit(False)), F.col("length_m") / 2
    ends = seen.groupBy("label", "length_m", "width_m", "heading_deg").agg(
        F.count_if(foam & (F.col("along") > half)).alias("fa"), F.count_if(foam & (F.col("along") < -half)).alias("fb"),
        F.max(F.when(foam & (F.col("along") > half), F.abs("along"))).alias("ta"), F.max(F.when(foam & (F.col("along") < -half), F.abs("along"))).alias("tb"),
    )
    total, px = F.col("fa") + F.col("fb"), res * res
    still = total * px < F.greatest(F.lit(2.0 * px), F.lit(0.15) * F.col("length_m") * F.col("width_m"))
    both = F.greatest("fa", "fb") < F.greatest(F.least("fa", "fb"), F.lit(1)) * 3
    course = F.pmod(F.when(F.col("fb") > F.col("fa"), F.col("heading_deg")).otherwise(F.col("heading_deg") + 180), F.lit(360.0))
    tail = F.when(F.col("fb") > F.col("fa"), F.col("tb")).otherwise(F.col("ta")) - F.col("length_m") / 2
    wake = F.when(still, 0.0).when(both, total * px / F.greatest("width_m", F.lit(float(res)))).otherwise(tail)
    return ends.select("label", (~still).alias("underway"), F.round(F.when(~still & ~both, course), 1).alias("course_deg"), F.round(wake, 1).alias("wake_m"))


def finished(found: DataFrame, least_m: float, most_m: float = MAX_HULL_M) -> DataFrame:
    """Hulls of a plausible length, longest first."""
    return found.where(F.col("length_m").between(least_m, most_m)).orderBy(F.col("length_m").desc(), "label")


def owned(found: DataFrame, block: int) -> DataFrame:
    """Of detections that overlapping tiles (``tile_row``, ``tile_col``) report, those whose centre lies in the tile's own core."""
    core = lambda c, t: F.floor((F.col(c) + 0.5) / block) == F.col(t)
    return found.where(core("row", "tile_row") & core("col", "tile_col"))


def as_observations(found: DataFrame, scene: Column, detector: str) -> DataFrame:
    """Detections as sightings: the confidence is the contrast over 30, at most 1."""
    return found.select(F.sha1(F.concat_ws("|", scene, F.lit(detector), "label").cast("binary")).substr(1, 16).alias("obs_id"), scene.alias("scene_id"), F.lit("vessel").alias("cls"), F.lit(detector).alias("detector"), F.round(F.least(F.lit(1.0), F.col("contrast") / 30), 3).alias("confidence"), "row", "col", "length_m", "width_m", F.col("heading_deg").alias("axis_deg"))


def optical_ships(pixels: DataFrame, res: float, height: int, width: int, k: float = 6.0, least_contrast: float = 0.03, least_length: float = 25.0, include_shore: bool = False) -> DataFrame:
    """Ships of an optical image (nir, green, red, blue, scl), hull rules applied, with excess per band and wake."""
    masks = cut(optical_masks(pixels, height, width))
    cells = targets(contrasted(masks, "nir", 400.0, res, height, width), k, least_contrast)
    found = blobs(cells, masks, res, 200.0, 5).join(ring_excess(cells, masks, ["blue", "green", "red", "nir"]), "label", "left")
    found = finished(found.where(hull_like()), least_length)
    found = found if include_shore else found.where("not near_shore")
    return found.join(wakes(found, cells, masks, res), "label", "left")


def radar_ships(pixels: DataFrame, db: str, res: float, height: int, width: int, calibrated: bool = True, k: float = 5.0, least_length: float = 25.0, include_shore: bool = False) -> DataFrame:
    """Ships of a radar image in decibel: water by threshold, specks in it filled, bright blobs."""
    wet = radar_water(pixels, db, max(1, round(120.0 / res)), calibrated).withColumn("_wet", F.lit(True))
    rows = cut(pixels.join(wet, ["row", "col"], "left").withColumn("_wet", F.coalesce("_wet", F.lit(False))).withColumn("_no", F.lit(False)))
    holes = small_holes(rows, "_wet", "_no", height, width, int(60_000 / res**2)).withColumn("_hole", F.lit(True))
    sea = (F.col("_wet") | F.coalesce("_hole", F.lit(False))) & F.col(db).isNotNull()
    masks = cut(rows.join(holes, ["row", "col"], "left").withColumn("sea", sea).withColumn("cloud", F.lit(False)).withColumn("land", F.col(db).isNotNull() & ~F.col("sea")))
    cells = targets(contrasted(masks, db, max(25 * res, 300.0), res, height, width), k, 8.0)
    found = finished(blobs(cells, masks, res, max(80.0, 2 * res * res), 3), least_length)
    return found if include_shore else found.where("not near_shore")
