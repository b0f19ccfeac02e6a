import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbweave.functions import geo, projection
from orbweave.operators import lookalikes, tiles, vectors

DIMS = 16


def cells(spark, e):
    """A table of an array (rows, columns, dims); NaN vectors become null."""
    rr, cc = np.mgrid[0 : e.shape[0], 0 : e.shape[1]]
    flat = [None if np.isnan(v[0]) else v.tolist() for v in e.reshape(-1, e.shape[2])]
    return spark.createDataFrame(list(zip(rr.ravel().tolist(), cc.ravel().tolist(), flat)), "row long, col long, v array<double>").repartition(4)


def farms(n=60, seed=0):
    """A common part everywhere, and three blocks that share another one."""
    rng = np.random.default_rng(seed)
    common, farm = 2 * rng.normal(size=DIMS), rng.normal(size=DIMS)
    e = common + 0.25 * rng.normal(size=(n, n, DIMS))
    for r, c in ((n * 2 // 15, n * 2 // 15), (n * 7 // 10, n // 3), (n * 5 // 12, n * 4 // 5)):
        block = e[r : r + 6, c : c + 6]
        block[:] = common + farm + 0.03 * rng.normal(size=block.shape)
    return e / np.linalg.norm(e, axis=-1, keepdims=True)


def test_one_example_finds_the_other_two_blocks(spark):
    e = farms()
    e[50:, 50:] = np.nan
    t = cells(spark, e)
    example = t.where("row = 10 and col = 10")
    found, facts = lookalikes.find_similar(t, "v", example, 10.0)
    rows = found.orderBy("place").collect()
    assert [r["n"] for r in rows] == [36, 36] and {(r["r0"], r["c0"]) for r in rows} == {(42, 20), (25, 48)}
    assert all(r["peak"] > 0.7 and 0 <= r["row"] - r["r0"] < 6 for r in rows) and rows[0]["peak"] >= rows[1]["peak"]
    assert facts["method"] == "cosine" and facts["background_median"] < 0.3 and facts["example_km2"] == pytest.approx(0.0036) and facts["matched_km2"] == pytest.approx(0.0072) and facts["cells"] == 3500
    with pytest.raises(ValueError):
        lookalikes.find_similar(t, "v", example.limit(0), 10.0)


def test_three_examples_or_a_counter_example_use_the_probe(spark):
    e = farms(40, seed=4)
    t = cells(spark, e)
    picks = [(6, 6), (7, 7), (8, 8)]
    where = " or ".join(f"(row = {r} and col = {c})" for r, c in picks)
    found, facts = lookalikes.find_similar(t, "v", t.where(where), 10.0, negatives=t.where("row = 0 and col = 0"), threshold=0.5)
    # The same with NumPy: whitening by all cells, the probe on all cells as background.
    flat = e.reshape(-1, DIMS)
    value, axis = np.linalg.eigh(np.cov(flat.T, bias=True))
    sd = np.sqrt(value)
    unit = lambda x: (z := (x - flat.mean(0)) @ (axis / (sd + sd.max() * 0.02))) / np.linalg.norm(z, axis=-1, keepdims=True)
    w, b = vectors.probe(unit(np.array([e[p] for p in picks])), unit(np.vstack([e[0, 0][None], flat])))
    score = 1 / (1 + np.exp(-(unit(flat) @ w + b)))
    assert facts["method"] == "probe" and facts["background_median"] == pytest.approx(np.median(score), abs=1e-6)
    want = {(int(r), int(c)) for r, c in np.argwhere(score.reshape(40, 40) >= 0.5)}
    one, _ = lookalikes.find_similar(t, "v", t.where("row = 7 and col = 7").withColumn("row", F.lit(None).cast("long")), 10.0, negatives=t.where("row = 0 and col = 0"), threshold=0.5)
    assert one.count() >= 1  # an example without a place has no region of its own
    inside = {(r, c) for r, c in want if 5 <= r < 11 and 5 <= c < 11}
    assert len(inside) == 36 and sum(r["n"] for r in found.collect()) <= len(want) - 36


def test_peaks_and_order_of_regions(spark):
    grid = np.zeros((9, 12))
    grid[1:3, 1:4], grid[1, 2] = 0.5, 0.9
    grid[5, 5:8] = [0.6, 0.9, 0.9]
    grid[8, 0] = 1.0  # too small
    rows = [(i, r, c, float(grid[r, c])) for i in (0, 1) for r in range(9) for c in range(12) if i == 0 or r < 4]
    t = spark.createDataFrame(rows, "image long, row long, col long, s double")
    found = [tuple(r[c] for c in ("image", "place", "n", "peak", "row", "col", "r0", "c0", "r1", "c1")) for r in lookalikes.score_regions(t, ["image"], "s", F.col("s") > 0.4).orderBy("image", "place").collect()]
    assert found == [(0, 1, 6, 0.9, 1, 2, 1, 1, 2, 3), (0, 2, 3, 0.9, 5, 6, 5, 5, 5, 7), (1, 1, 6, 0.9, 1, 2, 1, 1, 2, 3)]
    assert lookalikes.score_regions(t, ["image"], "s", F.col("s") > 0.4, top=1).count() == 2
    assert lookalikes.score_regions(t.limit(0), ["image"], "s", F.col("s") > 0.4).count() == 0


def test_only_the_changed_block_is_a_change(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 50, DIMS))
    b = a + 0.05 * rng.normal(size=a.shape)
    b[20:32, 20:32] = rng.normal(size=(12, 12, DIMS))
    b[3, 3] = -a[3, 3]  # a single cell is opened away
    found, facts = lookalikes.semantic_change(cells(spark, a), cells(spark, b), "v", 10.0)
    (r,) = found.collect()
    assert abs(r["n"] - 144) <= 20 and 20 <= r["row"] < 32 and 0.04 < facts["share_changed"] < 0.07 and facts["median_distance"] < 0.01
    coarse, _ = lookalikes.semantic_change(cells(spark, a), cells(spark, b), "v", 50.0)
    assert coarse.count() >= 2  # one cell is 2500 square metres there


def test_view_matches_numpy(spark):
    e = farms(30, seed=2)
    flat = e.reshape(-1, DIMS)
    _, _, vt = np.linalg.svd(flat - flat.mean(0), full_matrices=False)
    axis = vt[:3].T * np.sign(vt[:3].T[np.abs(vt[:3]).argmax(axis=1), np.arange(3)])
    p = (flat - flat.mean(0)) @ axis
    lo, hi = np.percentile(p, 2, axis=0), np.percentile(p, 98, axis=0)
    want = (np.clip((p - lo) / (hi - lo), 0, 1) * 255).astype(int)
    found = {(r["row"], r["col"]): (r["red"], r["green"], r["blue"]) for r in lookalikes.embedding_view(cells(spark, e), "v", DIMS).collect()}
    gap = np.array([np.abs(np.array(found[k // 30, k % 30]) - want[k]).max() for k in range(900)])
    assert gap.max() <= 1 and (gap == 0).mean() > 0.98


def test_k_means_matches_numpy(spark):
    e = farms(20, seed=5).reshape(-1, DIMS)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "id long, v array<double>")
    assigned, centres = vectors.k_means(t, "id", "v", 4, DIMS)
    first = [r["id"] for r in t.orderBy(F.xxhash64("id"), "id").limit(4).collect()]
    c = e[first].copy()
    for _ in range(25):
        lab = ((e[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        for k in range(4):
            if (lab == k).any():
                c[k] = e[lab == k].mean(0)
    lab = ((e[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    assert np.allclose(c, centres) and [r["cluster"] for r in assigned.orderBy("id").collect()] == lab.tolist()


def test_whitened_similarity_matches_numpy(spark):
    e = farms(12, seed=6).reshape(-1, DIMS)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, v array<double>")
    mean, axes = vectors.whitener(t, "v", DIMS)
    z = (e - e.mean(0)) @ axes
    assert np.allclose(mean, e.mean(0)) and np.allclose(np.cov(z.T, bias=True), np.diag(np.diag(np.cov(z.T, bias=True))), atol=1e-8)
    white = vectors.whitened(t, "vec_id", "v", mean, axes)
    top = vectors.similar(white, "v", white.where("vec_id = 7").select(F.col("v").alias("prototype")), 5).collect()
    cosine = z @ z[7] / np.linalg.norm(z, axis=1) / np.linalg.norm(z[7])
    assert [r["vec_id"] for r in top] == np.argsort(-cosine)[:5].tolist()


@pytest.mark.parametrize(("height", "width", "patch", "overlap", "scale"), [(37, 50, 16, 3, 1), (20, 90, 32, 6, 2), (9, 9, 16, 4, 1), (40, 40, 16, 0, 1)])
def test_feathered_tiles(spark, height, width, patch, overlap, scale):
    """A consistent model gives its image back; one that differs by tile is blended as by a plain loop."""
    rng = np.random.default_rng(height)
    image = rng.normal(size=(2, height, width))
    rr, cc = np.mgrid[0:height, 0:width]
    t = spark.createDataFrame(pd.DataFrame({"i": 1, "row": rr.ravel(), "col": cc.ravel(), "a": image[0].ravel(), "b": image[1].ravel()}))

    def array(frame):
        out = np.full((2, height * scale, width * scale), np.nan)
        for r in frame.collect():
            out[:, r["row"], r["col"]] = r["a"], r["b"]
        return out

    bigger = lambda x: x.repeat(scale, axis=1).repeat(scale, axis=2)
    same = tiles.feathered(t, ["i"], ["a", "b"], height, width, bigger, patch, overlap, scale)
    assert np.allclose(array(same), bigger(image))
    odd = lambda x: bigger(x - x.mean())
    step, big_h, big_w = patch - 2 * overlap, max(height, patch), max(width, patch)
    padded = np.zeros((2, big_h, big_w))
    padded[:, :height, :width] = image
    starts = lambda n: sorted({*range(0, n - patch + 1, step), n - patch})
    ramp = np.minimum(np.arange(patch * scale) + 1, np.arange(patch * scale)[::-1] + 1)
    win = np.minimum(np.minimum.outer(ramp, ramp) / max(overlap * scale, 1), 1.0)
    total, weight = np.zeros((2, big_h * scale, big_w * scale)), np.zeros((big_h * scale, big_w * scale))
    for y in starts(big_h):
        for x in starts(big_w):
            at = np.s_[y * scale : (y + patch) * scale, x * scale : (x + patch) * scale]
            total[(slice(None), *at)] += odd(padded[:, y : y + patch, x : x + patch]) * win
            weight[at] += win
    want = (total / weight)[:, : height * scale, : width * scale]
    assert np.allclose(array(tiles.feathered(t, ["i"], ["a", "b"], height, width, odd, patch, overlap, scale)), want)
    assert tiles.feathered(t.limit(0), ["i"], ["a", "b"], height, width, bigger, patch, overlap, scale).count() == 0


def test_projection(spark):
    rng = np.random.default_rng(9)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-79, 83, 400), rng.uniform(-180, 180, 400))] + [(0.0, 3.0), (45.0, 3.0), (83.9, 3.0), (-30.0, 3.0), (45.0, 6.0)]
    t = spark.createDataFrame(points, "lat double, lon double").withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon")))
    east, north = projection.to_utm(F.col("lat"), F.col("lon"), F.col("epsg"))
    there = t.select("lat", "lon", "epsg", east.alias("x"), north.alias("y"))
    lat, lon = projection.from_utm(F.col("x"), F.col("y"), F.col("epsg"))
    rows = there.select("*", lat.alias("back_lat"), lon.alias("back_lon")).collect()
    assert max(abs(r["back_lat"] - r["lat"]) for r in rows) < 2e-10 and max(abs((r["back_lon"] - r["lon"] + 180) % 360 - 180) for r in rows) < 1e-9

    def arc(lat_deg, n=200_000):
        """Length of the meridian from the equator, by Simpson's rule."""
        p = np.linspace(0, math.radians(lat_deg), n + 1)
        e2 = projection.FLATTENING * (2 - projection.FLATTENING)
        m = projection.RADIUS * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5
        return (m[0] + m[-1] + 4 * m[1:-1:2].sum() + 2 * m[2:-1:2].sum()) * (p[1] - p[0]) / 3

    by = {(r["lat"], r["lon"]): r for r in rows}
    for a in (0.0, 45.0, 83.9):
        assert by[a, 3.0]["x"] == pytest.approx(500000, abs=1e-6) and by[a, 3.0]["y"] == pytest.approx(0.9996 * arc(a), abs=1e-3)
    assert by[-30.0, 3.0]["y"] == pytest.approx(1e7 - 0.9996 * arc(30.0), abs=1e-3)
    # Off the axis: conformal, with the scale that distance from it gives.
    d = 1e-5
    near = spark.createDataFrame([(45.0, 6.0), (45.0 + d, 6.0), (45.0, 6.0 + d)], "lat double, lon double")
    p = [tuple(r) for r in near.select(*projection.to_utm(F.col("lat"), F.col("lon"), F.lit(32631))).collect()]
    e2, s = projection.FLATTENING * (2 - projection.FLATTENING), math.sin(math.radians(45))
    along = math.hypot(p[1][0] - p[0][0], p[1][1] - p[0][1]) / (math.radians(d) * projection.RADIUS * (1 - e2) / (1 - e2 * s * s) ** 1.5)
    across = math.hypot(p[2][0] - p[0][0], p[2][1] - p[0][1]) / (math.radians(d) * projection.RADIUS / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(45)))
    x = (p[0][0] - 500000) / 0.9996
    assert along == pytest.approx(across, rel=1e-6) and along == pytest.approx(0.9996 * (1 + x * x / (2 * 6378137.0**2)), rel=2e-5)


def test_boxes_hold_their_bent_sides(spark):
    t = spark.createDataFrame([(2.0, 50.0, 4.0, 51.0)], "w double, s double, e double, n double").withColumn("epsg", F.lit(32631))
    box = projection.box_to_utm(F.col("w"), F.col("s"), F.col("e"), F.col("n"), F.col("epsg"))
    corners = [c for lat in ("s", "n") for lon in ("w", "e") for c in projection.to_utm(F.col(lat), F.col(lon), F.col("epsg"))]
    x0, y0, x1, y1, *rest = t.select(*box, *corners).first()
    xs, ys = rest[0::2], rest[1::2]
    assert x0 == min(xs) and x1 == max(xs) and y1 == max(ys) and y0 < min(ys) - 100  # a parallel sags between its corners
    g = t.select(projection.grid_for(F.col("w"), F.col("s"), F.col("e"), F.col("n"), F.col("epsg"), 10.0, 1000).alias("g")).first()["g"]
    assert g["res"] == pytest.approx(max(x1 - x0, y1 - y0) / 1000) and 999 <= max(g["width"], g["height"]) <= 1001


def test_suppression_looks_at_one_detection_a_place(spark, monkeypatch):
    from orbweave.operators import raster

    met = []
    join = raster.range_join
    monkeypatch.setattr(raster, "range_join", lambda left, *more: met.append(left.count()) or join(left, *more))
    rows = [(i, "s", 1000.0 * (i % 3), 0.0, float(i * 7 % 40)) for i in range(40)] + [(90, "s", None, 0.0, 1.0), (91, "s", None, 0.0, 2.0), (92, "s", 0.0, 0.0, None)]
    boxes = spark.createDataFrame(rows, "obs_id long, scene_id string, x double, y double, confidence double")
    best = {max((r for r in rows[:40] if r[0] % 3 == k), key=lambda r: (r[4], -r[0]))[0] for k in range(3)}
    assert {r["obs_id"] for r in raster.suppress(boxes, ["scene_id"], 500.0).collect()} == best | {90, 91, 92} and met == [6]
