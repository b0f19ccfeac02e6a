"""Raster analytics on pixel tables: map algebra, neighbourhoods, regions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.domain import normalised_difference
from orbweave.operators.joins import range_join
from orbweave.operators.medians import medians
from orbweave.operators.windows import MAD
from orbweave.sources.paths import cut


def composite(pixels: DataFrame, key: list[str], bands: list[str], how: str = "median") -> DataFrame:
    """Per-pixel baseline of many images."""
    f = {"median": F.median, "mean": F.avg}[how]
    return pixels.groupBy(*key).agg(*[f(b).alias(b) for b in bands])


def robust_z(pixels: DataFrame, floors: dict[str, float], masks: dict[str, Column] | None = None, least: int = 100) -> DataFrame:
    """Columns against their own median and MAD over their masks, as ``z_<column>``; 0 if fewer than ``least`` pixels.

    The pixels are cut once; medians are counted over all columns together and come back as numbers, so
    neither a join nor a shuffle of pixels is left in the result.
    """
    masks = masks or {}
    own = lambda name, v: F.when(masks[name], v) if name in masks else v
    pixels = cut(pixels)
    middle = medians(pixels, {n: own(n, F.col(n)) for n in floors})
    off = {n: F.abs(F.col(n) - F.lit(m)) for n, (m, _) in middle.items() if m is not None}
    spread = medians(pixels, {n: own(n, gap) for n, gap in off.items()}) if off else {}
    z = {}
    for n, floor in floors.items():
        med, count = middle[n]
        z[f"z_{n}"] = F.lit(0.0) if count < least else (F.col(n) - F.lit(med)) / F.lit(max(spread[n][0] * MAD, floor))
    return pixels.withColumns(z)


def with_indices(pixels: DataFrame) -> DataFrame:
    """Vegetation, water and burn indices and brightness of both dates, and what the change classes mask by."""
    nd = lambda a, b: normalised_difference(F.col(a), F.col(b))
    for d in "ba":
        pixels = (
            pixels.withColumn(f"ndvi_{d}", nd(f"nir_{d}", f"red_{d}"))
            .withColumn(f"mndwi_{d}", nd(f"green_{d}", f"swir16_{d}"))
            .withColumn(f"nbr_{d}", nd(f"nir_{d}", f"swir22_{d}"))
            .withColumn(f"br_{d}", (F.col(f"blue_{d}") + F.col(f"green_{d}") + F.col(f"red_{d}")) / F.lit(3.0))
        )
    for name in ("mndwi", "ndvi", "nbr", "br", "red", "nir", "swir16", "swir22"):
        pixels = pixels.withColumn(f"d_{name}", F.col(f"{name}_a") - F.col(f"{name}_b"))
    known = F.col("mndwi_b").isNotNull() & F.col("mndwi_a").isNotNull() & F.col("ndvi_b").isNotNull() & F.col("ndvi_a").isNotNull()
    return pixels.withColumn("both", known).withColumn("land", known & ~((F.col("mndwi_b") > 0.1) & (F.col("mndwi_a") > 0.1)))


#: Floors of the robust spread, by difference; water is judged over all pixels and the rest over land.
FLOORS = {"d_mndwi": 0.03, "d_ndvi": 0.03, "d_nbr": 0.03, "d_br": 0.01, "d_swir16": 0.01, "d_red": 0.01, "d_nir": 0.01, "d_swir22": 0.01}


def optical_change(pixels: DataFrame, k: float = 3.0) -> DataFrame:
    """Change class of every pixel, first rule that holds: water, burn, vegetation, bright surface, other; null if none."""
    rows = robust_z(with_indices(pixels), FLOORS, {n: F.col("both" if n == "d_mndwi" else "land") for n in FLOORS})
    c = F.col
    water_b, water_a = c("mndwi_b") > 0.1, c("mndwi_a") > 0.1
    cva = F.sqrt((c("z_d_red") * c("z_d_red") + c("z_d_nir") * c("z_d_nir") + c("z_d_swir16") * c("z_d_swir16") + c("z_d_swir22") * c("z_d_swir22")) / 4)
    kind = (
        F.when(c("both") & (c("mndwi_b") < -0.05) & water_a & (c("z_d_mndwi") > k) & (c("swir16_b") > 0.12) & (c("swir16_a") < 0.08), "new_water")
        .when(c("both") & water_b & (c("mndwi_a") < -0.05) & (c("z_d_mndwi") < -k) & (c("swir16_a") > 0.12) & (c("swir16_b") < 0.08), "water_loss")
        .when(c("land") & (c("d_nbr") < -0.27) & (c("ndvi_b") > 0.25) & (c("z_d_nbr") < -k) & ~water_a & (c("red_a") < 0.12) & (c("br_a") <= c("br_b") + 0.02), "burn")
        .when(c("land") & (c("ndvi_b") > 0.4) & (c("d_ndvi") < -0.25) & (c("z_d_ndvi") < -k) & ~water_a, "vegetation_loss")
        .when(c("land") & (c("d_br") > 0.04) & (c("z_d_br") > k) & (c("z_d_swir16") > k) & (c("ndvi_a") < 0.3) & ~water_a, "new_bright_surface")
        .when(c("land") & (cva > k + 1) & ~water_a & ~water_b, "surface_change")
    )
    return rows.withColumn("change", kind).withColumn("cva", cva)


def radar_change(pixels: DataFrame, before: str, after: str, k: float = 3.0) -> DataFrame:
    """Log-ratio change of a radar band: at least 3 dB and beyond k spreads, up or down."""
    ratio = F.when((F.col(before) > 0) & (F.col(after) > 0), F.lit(10.0) * F.log10(F.try_divide(F.col(after), F.col(before))))
    rows = robust_z(pixels.withColumn("db", F.coalesce(ratio, F.lit(0.0))), {"db": 0.5})
    up, down = (F.col("db") >= 3) & (F.col("z_db") > k), (F.col("db") <= -3) & (F.col("z_db") < -k)
    return rows.withColumn("change", F.when(up, "radar_increase").when(down, "radar_decrease"))


def block_median(pixels: DataFrame, band: str, factor: int) -> DataFrame:
    return pixels.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.median(band).alias(band))


def multilook(pixels: DataFrame, band: str, reach: int = 2) -> DataFrame:
    """Mean of the valid pixels of each window where more than half of it is valid.

    Each pixel is sent to the windows it lies in, so the sums are one aggregation.
    """
    n = 2 * reach + 1
    around = F.sequence(F.lit(-reach), F.lit(reach))
    spread = pixels.where(F.col(band).isNotNull()).withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    sums = spread.groupBy((F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).agg(F.sum(band).alias("_s"), F.count(band).alias("_c"))
    inside = pixels.select("row", "col").distinct()
    return inside.join(sums, ["row", "col"]).where(F.col("_c") > n * n / 2).select("row", "col", (F.col("_s") / F.col("_c")).alias(band))


def otsu(values: DataFrame, column: str, bins: int = 256) -> DataFrame:
    """Threshold between two classes and the distance of their means, from one histogram; one row."""
    v = F.col(column)
    ends = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    slot = F.least(F.floor((v - F.col("lo")) / F.when(width == 0, 1.0).otherwise(width)), F.lit(bins - 1))
    counts = values.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(slot.alias("b"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    centre = F.col("lo") + (F.col("b") + 0.5) * width
    up = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    rows = counts.withColumn("centre", centre).withColumn("w0", F.sum("n").over(up)).withColumn("m0", F.sum(F.col("n") * F.col("centre")).over(up))
    rows = rows.withColumn("w1", F.sum("n").over(every) - F.col("w0")).withColumn("m1", F.sum(F.col("n") * F.col("centre")).over(every) - F.col("m0"))
    gap = F.try_divide(F.col("m0"), F.col("w0")) - F.try_divide(F.col("m1"), F.col("w1"))
    between = F.coalesce(F.col("w0") * F.col("w1") * gap * gap, F.lit(0.0))
    best = F.max_by(F.struct(F.col("centre").alias("threshold"), F.abs(gap).alias("separation")), F.struct(F.round(between, 6), -F.col("b")))
    return rows.agg(best.alias("x")).select("x.*")


def regions(cells: DataFrame, by: list[str], diagonal: bool = False) -> DataFrame:
    """Connected regions of the cells: ``label`` is the smallest row-major cell of the region.

    Edges between neighbouring cells are found once by equi-joins on shifted cells; rounds then spread minimal
    labels over them and follow each label to what its own cell has become, so an image need not
    fit one task; every join is by a shuffle, as broadcasts would bring each round's cells to the driver. ``by`` separates images. Cells carry ``row`` and ``col``.
    """
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    ids = cut(cells.select(*by, "row", "col").distinct())
    shifted = ids.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("_d"))
    half = shifted.select(*by, "_r", "_c", (F.col("_r") + F.col("_d.i")).alias("row"), (F.col("_c") + F.col("_d.j")).alias("col")).join(ids.hint("merge"), [*by, "row", "col"])
    back = half.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("_r").alias("row"), F.col("_c").alias("col"))
    edges = cut(half.select(*by, "_r", "_c", "row", "col").unionByName(back))
    labels = ids.withColumn("label", F.struct("row", "col"))
    while True:
        sent = labels.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("label").alias("_low"))
        least = edges.join(sent.hint("merge"), [*by, "_r", "_c"]).groupBy(*by, "row", "col").agg(F.min("_low").alias("_low"))
        step = cut(labels.join(least.hint("merge"), [*by, "row", "col"], "left").select(*by, "row", "col", "label", F.least("label", "_low").alias("low")))
        jump = step.select(*by, F.struct("row", "col").alias("low"), F.col("low").alias("_jump"))
        moved = cut(step.join(jump.hint("merge"), [*by, "low"], "left").select(*by, "row", "col", "label", F.least("low", "_jump").alias("next")))
        changed = moved.where(F.col("next") != F.col("label")).limit(1).count()
        labels = moved.select(*by, "row", "col", F.col("next").alias("label"))
        if not changed:
            break
    return labels.select(*by, "row", "col", F.concat_ws("/", F.col("label.row").cast("string"), F.col("label.col").cast("string")).alias("label"))


def shape(cells: DataFrame, by: list[str], res: float) -> DataFrame:
    """Size, centroid, length, width and axis of regions from the moments of their cells."""
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    m = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("row"), F.avg(c).alias("col"),
        F.var_pop(r).alias("vr"), F.var_pop(c).alias("vc"), F.covar_pop(r, c).alias("rc"),
    )
    half, root = (F.col("vr") + F.col("vc")) / 2, F.sqrt(F.pow((F.col("vr") - F.col("vc")) / 2, 2) + F.col("rc") * F.col("rc"))
    heading = F.pmod(F.degrees(F.lit(0.5) * F.atan2(F.col("rc") * -2, F.col("vr") - F.col("vc"))), F.lit(180.0))
    return m.select(
        *by, "n", (F.col("n") * res * res).alias("area_m2"), "row", "col",
        (F.sqrt(F.lit(12.0) * (half + root)) * res).alias("length_m"), (F.sqrt(F.lit(12.0) * F.greatest(half - root, F.lit(0.0))) * res).alias("width_m"), heading.alias("axis_deg"),
    )


def region_confidence(score: Column, k: float, area: Column, least: float, n_base: int) -> Column:
    raw = F.lit(0.3) + F.lit(0.08) * F.least(score - k, F.lit(5.0)) + F.lit(0.08) * F.log10(F.greatest(area / least, F.lit(1.0))) + (0.12 if n_base >= 3 else 0.0)
    return F.least(F.greatest(raw, F.lit(0.05)), F.lit(0.95))


def hull_like() -> Column:
    """Could a blob be a hull: shape, spine, fill and spectrum. Columns length_m, width_m, area_m2, contrast, wiggle_m, blue, red, nir."""
    c = F.col
    fill = c("area_m2") / (c("length_m") * c("width_m"))
    fat = (c("length_m") >= 120) & (c("width_m") > F.lit(0.4) * c("length_m"))
    ragged = (c("length_m") >= 100) & (c("contrast") < 40) & ((c("wiggle_m") > 6) | (fill < 0.85) | ((c("wiggle_m") > 4) & (c("contrast") < 20)))
    spectrum = c("blue").isNotNull() & c("red").isNotNull() & c("nir").isNotNull()
    unpainted = (c("red") < 0) | ((c("red") < 0.02) & (c("contrast") < 15))
    flat = (c("nir") < F.lit(1.15) * c("blue")) & ((c("contrast") < 10) | ((c("contrast") < 25) & (c("width_m") > F.lit(0.3) * c("length_m"))))
    return ~(fat | ragged | (spectrum & (unpainted | flat)))


def density_grid(points: DataFrame, box: tuple[float, float, float, float], bandwidth_m: float, looks: int) -> DataFrame:
    """Objects per look and square kilometre, smoothed by a Gaussian of the bandwidth (cut at 4 deviations, edges mirrored)."""
    w, s, e, n = box
    kx = math.cos(math.radians((s + n) / 2)) * 111320.0
    nx, ny = max(1, min(400, int((e - w) * kx / bandwidth_m))), max(1, min(400, int((n - s) * 110540.0 / bandwidth_m)))
    cx, cy = (e - w) * kx / nx, (n - s) * 110540.0 / ny
    i = F.floor((F.lit(n) - F.col("lat")) / F.lit(n - s) * ny).cast("long")
    j = F.floor((F.col("lon") - F.lit(w)) / F.lit(e - w) * nx).cast("long")
    grid = points.select(i.alias("i"), j.alias("j")).where(F.col("i").between(0, ny - 1) & F.col("j").between(0, nx - 1)).groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))
    for axis, size, sigma in (("i", ny, bandwidth_m / cy), ("j", nx, bandwidth_m / cx)):
        reach = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        kernel /= kernel.sum()
        taps = F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(float(x)).alias("x")) for o, x in zip(range(-reach, reach + 1), kernel, strict=True)])
        # A source cell p also feeds from its mirror images -1-p and 2*size-1-p.
        images = F.array(F.col(axis), -F.col(axis) - 1, F.lit(2 * size - 1) - F.col(axis))
        fed = grid.withColumn("_p", F.explode(images)).withColumn("_t", F.explode(taps)).withColumn(axis, F.col("_p") + F.col("_t.o")).where(F.col(axis).between(0, size - 1))
        grid = fed.groupBy("i", "j").agg(F.sum(F.col("v") * F.col("_t.x")).alias("v"))
    return grid.select("i", "j", (F.col("v") / max(looks, 1) / (cx * cy / 1e6)).alias("per_km2_per_look"))


def suppress(boxes: DataFrame, by: list[str], reach_m: float) -> DataFrame:
    """Greedy suppression: going down in confidence (ties by id), a detection within reach of a kept one goes.

    In rounds: who has no better undecided neighbour stays, its neighbours go. That gives the greedy
    result, and neighbours come from a grid join, so no task holds a scene. Of detections at one place only the
    best takes part: it stays or what it goes for is as near and better to all others there, so they go.
    """
    known = F.lit(True)
    for c in (*by, "x", "y", "confidence"):
        known = known & F.col(c).isNotNull()
    known = known & ~F.isnan(F.col("x") + F.col("y"))
    place = Window.partitionBy(*by, "x", "y").orderBy(F.col("confidence").desc(), "obs_id")
    boxes = cut(boxes.withColumn("_n", F.row_number().over(place)).where((F.col("_n") == 1) | ~known).drop("_n"))
    near = range_join(boxes, boxes, by, "x", "y", reach_m, (F.col("l_confidence") < F.col("r_confidence")) | ((F.col("l_confidence") == F.col("r_confidence")) & (F.col("l_obs_id") > F.col("r_obs_id"))))
    edges = cut(near.select(F.col("l_obs_id").alias("worse"), F.col("r_obs_id").alias("better")).distinct())
    undecided, kept = cut(boxes.select("obs_id")), None
    while True:
        best = cut(undecided.join(edges.select(F.col("worse").alias("obs_id")), "obs_id", "left_anti"))
        kept = best if kept is None else kept.unionByName(best)
        gone = edges.join(best.select(F.col("obs_id").alias("better")), "better", "left_semi").select(F.col("worse").alias("obs_id")).distinct()
        undecided = cut(undecided.join(best, "obs_id", "left_anti").join(gone, "obs_id", "left_anti"))
        if not undecided.limit(1).count():
            return boxes.join(kept, "obs_id", "left_semi")
        alive = undecided.select(F.col("obs_id"))
        edges = cut(edges.join(alive.withColumnRenamed("obs_id", "worse"), "worse", "left_semi").join(alive.withColumnRenamed("obs_id", "better"), "better", "left_semi"))


def parallax(east: Column, north: Column, axis: Column, track: Column, per_m: float) -> Column:
    """Speed, heading and altitude of an aircraft from its apparent velocity and its axis.

    Cramer's rule for u = s h - p t with both senses of the axis; ill-posed near the track's direction.
    """
    t_e, t_n = F.sin(F.radians(track)), F.cos(F.radians(track))

    def solved(heading: Column) -> Column:
        h_e, h_n = F.sin(F.radians(heading)), F.cos(F.radians(heading))
        det = h_e * -t_n + t_e * h_n
        speed = (east * -t_n + t_e * north) / det
        shift = (h_e * north - h_n * east) / det
        good = (F.abs(det) >= 0.25) & (speed > 0) & (shift > -5 * per_m * 1000)
        return F.when(good, F.struct(F.greatest(shift, F.lit(0.0)).alias("p"), speed.alias("speed_ms"), F.pmod(heading, F.lit(360.0)).alias("heading_deg")))

    best = F.array_min(F.filter(F.array(solved(axis), solved(axis + 180)), lambda x: x.isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["speed_ms"].alias("speed_ms"), best["heading_deg"].alias("heading_deg"), (best["p"] / per_m).alias("altitude_m")))
