import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbweave.operators import matching, movers
from orbweave.operators.medians import medians, quantiles

N = 90


def scene(speed=200.0, heading=120.0, rooftop=True, long=False, seed=3):
    """A blob that moves from band to band and one that does not, in noise."""
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[0:N, 0:N]
    a = math.radians(heading)
    out = {}
    for b, t in movers.BAND_SECONDS.items():
        r, c = 45.0 - math.cos(a) * speed / 10 * t, 38.0 + math.sin(a) * speed / 10 * t
        along, across = (xx - c) * math.sin(a) - (yy - r) * math.cos(a), (xx - c) * math.cos(a) + (yy - r) * math.sin(a)
        wide = (3.6, 1.0) if long else (1.2, 1.2)
        out[b] = 0.2 + 0.004 * rng.normal(size=(N, N)) + 0.25 * np.exp(-(along**2) / (2 * wide[0] ** 2) - across**2 / (2 * wide[1] ** 2))
        if rooftop:
            out[b] += 0.25 * np.exp(-((yy - 20) ** 2 + (xx - 70) ** 2) / (2 * 1.2**2))
    return out


def frame(spark, images):
    parts = []
    for name, bands in images.items():
        rr, cc = np.mgrid[0:N, 0:N]
        parts.append(pd.DataFrame({"image": name, "row": rr.ravel(), "col": cc.ravel()} | {b: v.ravel() for b, v in bands.items()}))
    return spark.createDataFrame(pd.concat(parts))


def plain_peaks(x, valid):
    """Strengths and peaks of one band by loops over the array."""
    filled = np.where(np.isnan(x), np.nanmedian(x), x)
    k = np.exp(-0.5 * (np.arange(-12, 13) / 3.0) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = np.pad(filled if axis == 0 else smooth, [(12, 12) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        smooth = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, pad)
    high = filled - smooth
    v = high[valid]
    z = np.where(valid, high, 0.0) / (np.median(np.abs(v - np.median(v))) * 1.4826 or 1e-4)
    m, found = np.abs(z), []
    for r in range(N):
        for c in range(N):
            around = m[max(r - 2, 0) : r + 3, max(c - 2, 0) : c + 3]
            if valid[r, c] and m[r, c] > 5 and m[r, c] == around.max():
                w = m[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2]
                gy, gx = np.mgrid[max(r - 1, 0) : min(r + 2, N), max(c - 1, 0) : min(c + 2, N)]
                found.append((r, c, round((gy * w).sum() / w.sum(), 6), round((gx * w).sum() / w.sum(), 6), round(m[r, c], 5)))
    return found


def test_peaks_match_a_plain_walk(spark):
    images = {"a": scene(), "b": scene(heading=300.0, seed=5)}
    images["b"]["green"][30:34, 10:60] = np.nan
    images["a"]["blue"][0, 0] = 0.9  # a peak in the corner
    z = movers.strengths(frame(spark, images), ["image"], N, N)
    found = movers.peaks(z, ["image"]).collect()
    for name, bands in images.items():
        valid = np.all([np.isfinite(v) for v in bands.values()], axis=0)
        for b, x in bands.items():
            own = sorted((r["row"], r["col"], round(r["r"], 6), round(r["c"], 6), round(r["strength"], 5)) for r in found if r["image"] == name and r["band"] == b)
            assert own == plain_peaks(x, valid)


def test_finds_the_mover_and_not_the_rooftop(spark):
    images = {"fast": scene(), "slow": scene(speed=20.0), "north": scene(speed=250.0, heading=5.0, long=True), "still": scene(speed=0.0), "torn": scene()}
    for v in images["torn"].values():
        v[:, 15:] = np.nan  # less than a fifth is known
    found = {r["image"]: r for r in movers.airborne(frame(spark, images), ["image"], N, N, 10.0).collect()}
    assert set(found) == {"fast", "north"}
    fast, north = found["fast"], found["north"]
    assert abs(fast["apparent_speed_ms"] - 200) < 15 and abs(fast["apparent_heading_deg"] - 120) < 5 and fast["bands_matched"] == 4
    assert fast["axis_deg"] is None and fast["note"].startswith("heading not measurable") and fast["speed_ms"] is None
    assert abs(north["apparent_speed_ms"] - 250) < 15 and abs(north["axis_deg"] - 5) < 6 and "parallel" in north["note"]
    assert movers.airborne(frame(spark, {"x": scene()}).limit(0), ["image"], N, N, 10.0).count() == 0


def test_height_is_told_where_the_axis_crosses_the_track(spark):
    """A long aircraft on 110 degrees whose image is shifted by its height along 193 degrees."""
    speed, heading, height, track = 240.0, 110.0, 4000.0, 193.0
    h, t = math.radians(heading), math.radians(track)
    e = speed * math.sin(h) - height * movers.SHIFT_PER_M * math.sin(t)
    n = speed * math.cos(h) - height * movers.SHIFT_PER_M * math.cos(t)
    rng = np.random.default_rng(8)
    yy, xx = np.mgrid[0:N, 0:N]
    bands = {}
    for b, s in movers.BAND_SECONDS.items():
        r, c = 45.0 - n / 10 * s, 35.0 + e / 10 * s
        along, across = (xx - c) * math.sin(h) - (yy - r) * math.cos(h), (xx - c) * math.cos(h) + (yy - r) * math.sin(h)
        bands[b] = 0.2 + 0.002 * rng.normal(size=(N, N)) + 0.3 * np.exp(-(along**2) / 26 - across**2 / 2)
    (a,) = movers.airborne(frame(spark, {"x": bands}), ["image"], N, N, 10.0, track).collect()
    assert abs(a["axis_deg"] - 110) < 4 and abs(a["speed_ms"] - 240) < 20 and abs(a["altitude_m"] - 4000) < 2500 and a["note"] == ""


def test_greedy_matching_is_the_walk(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(a), int(b), int(w), i) for i, (g, a, b, w) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 25, 400), rng.integers(0, 25, 400), rng.integers(0, 30, 400)))]
    rows += [(0, 1, None, 0, 900), (0, None, 2, 0, 901)]
    edges = spark.createDataFrame(rows, "g long, a long, b long, w long, id long")
    found = sorted(r["id"] for r in matching.greedy_matching(edges, ["g"], "a", "b", [F.col("w"), F.col("id")]).collect())
    used, want = set(), []
    for g, a, b, w, i in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[3], r[4])):
        if ("a", g, a) not in used and ("b", g, b) not in used:
            used |= {("a", g, a), ("b", g, b)}
            want.append(i)
    assert found == sorted(want)
    chain = spark.createDataFrame([(i, i + d, i, 2 * i + d) for i in range(12) for d in (0, 1)], "a long, b long, w long, id long")
    assert sorted(r["id"] for r in matching.greedy_matching(chain, [], "a", "b", [F.col("id")]).collect()) == [2 * i for i in range(12)]
    assert matching.greedy_matching(edges.limit(0), ["g"], "a", "b", [F.col("id")]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 30_001])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    v, w = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    v[0] = np.inf if n > 2 else v[0]
    g = np.where(np.arange(n) % 3, 0, rng.integers(0, 5, n))
    rows = spark.createDataFrame(pd.DataFrame({"g": g, "v": v, "w": w})).withColumn("w", F.when(F.col("w") == 3, F.lit(None)).otherwise(F.col("w")))
    shares = [0.0, 0.02, 0.5, 0.995, 1.0]
    found = {(r["g"], r["name"], r["share"]): r["value"] for r in quantiles(rows, {"v": F.col("v"), "w": F.col("w")}, shares, ["g"]).collect()}
    for k in set(g.tolist()):
        for name, own in (("v", v[g == k]), ("w", w[(g == k) & (w != 3)])):
            for s in shares:
                if not len(own):
                    assert (k, name, s) not in found
                    continue
                at, x = s * (len(own) - 1), np.sort(own)
                low, high = x[math.floor(at)], x[math.ceil(at)]
                want = low if low == high else low + (high - low) * (at % 1)
                assert found[k, name, s] == pytest.approx(want, rel=1e-12)
    whole = medians(rows, {"v": F.col("v"), "none": F.lit(None), "nan": F.lit(float("nan"))})
    assert whole["v"][1] == n and whole["v"][0] == pytest.approx(float(np.median(v))) and whole["none"] == whole["nan"] == (None, 0)


def test_strengths_near_strong_pixels_are_all_that_is_looked_at(spark, monkeypatch):
    """Images as groups, as strips of lines, and cut down to what is near strong pixels give the same peaks and strengths."""
    images = {"a": scene(), "b": scene(heading=300.0, seed=5)}
    images["b"]["green"][30:34, 10:60] = np.nan
    images["a"]["blue"][0, 0] = 0.9
    rows = lambda z: {(r["image"], r["row"], r["col"]): [round(r[f"z_{b}"], 6) for b in movers.BAND_SECONDS] for r in z.collect()}
    pixels = frame(spark, images)
    whole = movers.strengths(pixels, ["image"], N, N)
    near = movers.strengths(pixels, ["image"], N, N, near=movers.PEAK)
    every, few = rows(whole), rows(near)
    strong = [k for k, v in every.items() if max(map(abs, v)) > movers.PEAK]
    assert few == {k: v for k, v in every.items() if any(k[0] == i and abs(k[1] - r) <= 2 and abs(k[2] - c) <= 2 for i, r, c in strong)} and len(few) * 5 < len(every)
    assert sorted(map(tuple, movers.peaks(near, ["image"]).collect())) == sorted(map(tuple, movers.peaks(whole, ["image"]).collect()))
    monkeypatch.setattr(movers, "GROUP_PX", 0)
    assert rows(movers.strengths(pixels, ["image"], N, N)) == every and rows(movers.strengths(pixels, ["image"], N, N, near=movers.PEAK)) == few
