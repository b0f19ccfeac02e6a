"""Expectations of the operators on hand-made rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import geo, text
from orbweave.operators import events, raster, store, tracking, vectors

T0 = datetime(2026, 3, 1, 4)
OBS = "obs_id string, time timestamp, site string, scene_id string, cls string, source string, lat double, lon double, length_m double, width_m double, axis_deg double, underway boolean"


def sight(i, days, north=0.0, east=0.0, length=200.0, cls="vessel", axis=None, underway=None, scene=None):
    lat = 25.0 + north / 110574
    lon = 56.0 + east / (111320 * np.cos(np.radians(25.0)))
    return (f"o{i}", T0 + timedelta(days=days), "X", scene or f"s{days}", cls, "sentinel-2", lat, float(lon), length, length / 6, axis, underway)


def links(spark, rows, **kw):
    return tracking.build_tracks(spark.createDataFrame(rows, OBS), 4e8, **kw).collect()


def test_stationary_object_links(spark):
    found = [r for r in links(spark, [sight(1, 0), sight(2, 2, north=8)]) if r["chosen"]]
    assert len({r["track_id"] for r in found}) == 1
    assert max(r["prob"] for r in found if r["obs_id"] == "o2") > 0.8


def test_other_length_starts_a_track(spark):
    found = [r for r in links(spark, [sight(1, 0, length=300.0), sight(2, 2, north=8, length=60.0)]) if r["chosen"]]
    assert len({r["track_id"] for r in found}) == 2


def test_two_misses_are_a_departure(spark):
    rows = [sight(1, 0), sight(2, 0, north=5000, scene="s0"), sight(3, 2, north=5000), sight(4, 4, north=5000)]
    found = {r["obs_id"]: r["status"] for r in links(spark, rows) if r["chosen"]}
    assert found["o1"] == "departed" and found["o4"] == "active"


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n, m in ((3, 3), (2, 5), (5, 3), (1, 4)):
        cost = rng.random((n, m))
        i, j = tracking.assignment(cost)
        assert len(i) == min(n, m) and len(set(j.tolist())) == len(j)
        small = cost if n <= m else cost.T
        best = min(sum(small[r, c] for r, c in enumerate(p)) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert cost[i, j].sum() == pytest.approx(best)


def test_expression_and_tracker_agree(spark):
    rows = [sight(1, 0, axis=10.0), sight(2, 1, north=80, axis=14.0, length=195.0, underway=True)]
    o = tracking.with_errors(spark.createDataFrame(rows, OBS)).withColumnRenamed("ls", "length_sigma").withColumn("underway", F.col("underway") == 1)
    a = o.where("id = 'o1'").select(*[F.col(c).alias(f"a_{c}") for c in o.columns], *[F.lit(None).cast("double").alias(f"a_{v}") for v in ("vx", "vy", "v_sigma")])
    b = o.where("id = 'o2'").select(*[F.col(c).alias(f"b_{c}") for c in o.columns])
    lr = a.crossJoin(b).select(tracking.likelihood_ratio(4e8).alias("lr")).first()["lr"]
    (p,) = [r["prob"] for r in links(spark, rows) if r["obs_id"] == "o2" and r["chosen"]]
    assert lr > 1 and p == pytest.approx(lr / (1 + lr), abs=2e-3)


def test_count_drop_and_spike(spark):
    rows, k = [], 0
    for day, n in enumerate([10, 11, 10, 11, 10, 11, 10, 40, 10, 0, 1]):
        for _ in range(n):
            k += 1
            rows.append(sight(k, day * 5))
    kinds = {r["scene_id"]: r["kind"] for r in events.count_anomalies(spark.createDataFrame(rows, OBS)).collect()}
    assert kinds["s35"] == "count_spike"
    steady = [sight(1000 + i, day * 5) for day, n in enumerate([30, 31, 30, 31, 30, 31, 30, 31, 2]) for i in range(day * 100, day * 100 + n)]
    assert {r["scene_id"]: r["kind"] for r in events.count_anomalies(spark.createDataFrame(steady, OBS)).collect()} == {"s40": "count_drop"}


def boxes_of(spark, rows, away=()):
    """One scene a row of sightings; those in ``away`` imaged another place."""
    names = sorted({r[3] for r in rows}, key=lambda n: int(n[1:]))
    return spark.createDataFrame([(n, "X", T0 + timedelta(days=int(n[1:])), 1.0, *((10.0, 10.0, 11.0, 11.0) if n in away else (55.0, 24.0, 57.0, 26.0))) for n in names], "scene_id string, site string, time timestamp, clear double, w double, s double, e double, n_lat double")


def test_scenes_that_look_elsewhere_miss_nothing(spark):
    rows = [sight(1, 0), sight(2, 0, north=5000, scene="s0"), sight(3, 2, north=5000), sight(4, 4, north=5000)]
    status = lambda away: {r["obs_id"]: r["status"] for r in links(spark, rows, coverage=boxes_of(spark, rows, away)) if r["chosen"]}["o1"]
    assert status(()) == "departed" and status(("s2",)) != "departed" and status(("s2", "s4")) != "departed"


def test_unusual_places_count_the_looks_that_covered_them(spark):
    rng = np.random.default_rng(0)
    rows = [sight(k * 10 + i, k, north=float(rng.normal(0, 300)), east=float(rng.normal(0, 300))) for k in range(10) for i in range(5)]
    rows += [sight(900, 10, north=9000), sight(901, 10, north=9000, east=800, underway=True)]
    obs = spark.createDataFrame(rows, OBS)
    found = lambda away: [(r["obs_id"], r["looks"]) for r in events.unusual_locations(obs, boxes_of(spark, rows, away)).collect()]
    assert found(()) == [("o900", 10)] and found(("s1", "s2", "s3")) == [("o900", 7)]
    assert found(("s1", "s2", "s3", "s4", "s5")) == []
    assert [r["looks"] for r in events.unusual_locations(obs, boxes_of(spark, rows).drop("w", "s", "e", "n_lat")).collect()] == [10]


def test_pairs_seen_together_weigh_more(spark):
    rows = [sight(10 * d + i, d, north=60.0 * i, axis=90.0) for d in range(3) for i in (0, 1)]
    obs = spark.createDataFrame(rows, OBS)
    named = obs.withColumn("track_id", F.concat(F.lit("T"), F.substring("obs_id", -1, 1)))
    severity = lambda o: {r["severity"] for r in events.sts_candidates(o, boxes_of(spark, rows)).collect()}
    assert severity(obs) == {0.6} and severity(named) == {0.8} and severity(named.where("scene_id != 's2'")) == {0.7}


def test_refresh_keeps_distances_and_replaces_what_it_stores(spark, tmp_path):
    from orbweave.operators import refresh

    rows = [sight(1, 0, length=300.0), sight(2, 0, north=14500, length=150.0, scene="s0"), sight(3, 0, north=-14500, length=160.0, scene="s0"), sight(4, 0, east=14800, length=170.0, scene="s0")]
    rows += [sight(10 + d, d, length=300.0) for d in (1, 2, 3)]
    obs, scenes, root = spark.createDataFrame(rows, OBS), boxes_of(spark, rows), str(tmp_path / "store")
    out = refresh.refresh_sites(obs, scenes, None, 4e8)
    kinds = [r["kind"] for r in out["events"].collect()]
    assert kinds.count("possible_task_group") == 1  # 14.5 km due north and south, 14.8 km east
    stored = lambda: {n: sorted(map(str, spark.read.parquet(f"{root}/{n}").collect())) for n in ("links", "tracks", "events")}
    assert refresh.replaced(spark, root, out).count() == len(kinds)
    first = stored()
    assert refresh.replaced(spark, root, refresh.refresh_sites(obs, scenes, None, 4e8)).count() == 0 and stored() == first
    alone = refresh.refresh_sites(obs.where("length_m = 300"), scenes, None, 4e8)
    refresh.replaced(spark, root, alone)
    left = spark.read.schema(out["events"].schema).parquet(f"{root}/events")
    assert sorted(r["event_id"] for r in left.collect()) == sorted(r["event_id"] for r in alone["events"].collect())
    assert refresh.replaced(spark, root, out).count() == len(kinds)  # a store without events is one all the same


def test_alongside_pairs(spark):
    pair = [sight(1, 0, axis=0.0), sight(2, 0, east=60, axis=5.0, scene="s0")]
    passing = [sight(3, 1, axis=0.0, underway=True), sight(4, 1, east=60, axis=5.0, underway=False, scene="s1")]
    crossing = [sight(5, 2, axis=0.0), sight(6, 2, east=60, axis=80.0, scene="s2")]
    found = events.alongside_pairs(spark.createDataFrame(pair + passing + crossing, OBS)).select("l_scene_id").collect()
    assert [r[0] for r in found] == ["s0"]


def test_store_replacement(spark):
    schema = "event_id string, site string, kind string"
    old = spark.createDataFrame([("a", "X", "arrival"), ("b", "X", "change_burn"), ("c", "Y", "arrival"), ("d", "X", "arrival")], schema)
    new = spark.createDataFrame([("a", "X", "arrival"), ("e", "X", "arrival")], schema)
    table, fresh = store.replace_events(old, new, "X")
    assert sorted(r[0] for r in table.collect()) == ["a", "b", "c", "e"]
    assert [r[0] for r in fresh.collect()] == ["e"]
    assert store.insert_ignore(old, old, ["event_id"]).count() == 0


def test_positions_from_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("MMSI,BaseDateTime,LAT,LON,SOG,COG,VesselName,Length\n1,2026-03-01T04:06:00,25.0,56.0,x,10,A,200\nbad,2026-03-01T04:06:00,25,56,1,1,B,1\n2,nonsense,25,56,1,1,C,1\n3,2026-03-01 04:06:00Z,25.5,56.5,,,D,\n")
    rows = {r["mmsi"]: r for r in store.read_positions(spark, str(path)).collect()}
    assert set(rows) == {1, 3} and rows[1]["sog"] is None and rows[1]["length_m"] == 200.0 and rows[3]["lat"] == 25.5


def test_parallax_solve(spark):
    h, t, s, p = np.radians(300.0), np.radians(193.0), 130.0, 900 * 0.0095
    u = s * np.array([np.sin(h), np.cos(h)]) - p * np.array([np.sin(t), np.cos(t)])
    x = spark.range(1).select(raster.parallax(F.lit(float(u[0])), F.lit(float(u[1])), F.lit(120.0), F.lit(193.0), 0.0095).alias("x")).first()["x"]
    assert (round(x["speed_ms"], 3), round(x["heading_deg"], 3), round(x["altitude_m"], 1)) == (130.0, 300.0, 900.0)


def test_regions_join_across_a_snake(spark):
    cells = [(0, c) for c in range(6)] + [(r, 5) for r in range(6)] + [(5, c) for c in range(6)] + [(2, 2)]
    found = raster.regions(spark.createDataFrame(cells, "row long, col long"), []).groupBy("label").count().collect()
    assert sorted(r["count"] for r in found) == [1, 16]


def test_areas_and_text(spark):
    assert geo.parse_area("somewhere") is None
    w, s, e, n = geo.parse_area("25.0, 56.0")
    assert w < 56 < e and s < 25 < n
    with pytest.raises(ValueError):
        geo.parse_area("95,10")
    asked = ["ships near Jebel Ali today", "what is at 25.1,56.2?", 'show "the old port"', "any change?", None]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select(text.place_of(F.col("q")).alias("p")).collect()
    assert [r["p"] for r in rows] == ["Jebel Ali", "25.1,56.2", "the old port", None, None]


def test_probe_separates():
    rng = np.random.default_rng(0)
    yes, no = rng.standard_normal((20, 4)) + 2, rng.standard_normal((60, 4)) - 2
    w, b = vectors.probe(yes, no)
    assert ((yes @ w + b) > 0).all() and ((no @ w + b) < 0).all()


def test_streamed_tracks_are_those_of_the_batch(spark):
    from orbweave.plans import registry
    from orbweave.sources import fixtures as fx

    data = "/root/testdata/sf0.001"
    told = sorted(tuple(r) for r in registry.QUERIES["st5_streamed_tracks"](spark, data).collect())
    batch = tracking.build_tracks(fx.observations(spark, data), 4e8)
    assert told == sorted(tuple(r) for r in batch.select("site", "obs_id", "track_id", "prob", "chosen").collect())


def test_sweep_survives_a_crash_between_its_writes(spark, tmp_path):
    from orbweave.streaming import sweep

    root = str(tmp_path / "s")
    rows = spark.createDataFrame([sight(1, 0), sight(2, 1)], OBS)
    count = lambda h: h.groupBy("site").agg(F.count(F.lit(1)).alias("n"))

    def broken(history):
        raise RuntimeError("lost between the writes")

    with pytest.raises(RuntimeError):
        sweep.refresh(spark, root, broken)(rows, 0)
    sweep.refresh(spark, root, count)(rows, 0)
    sweep.refresh(spark, root, count)(rows, 0)
    assert [tuple(r) for r in spark.read.parquet(f"{root}/derived").select("site", "n").collect()] == [("X", 2)]
    assert spark.read.parquet(f"{root}/observations").count() == 2
    (tmp_path / "t" / "observations").mkdir(parents=True)
    (tmp_path / "t" / "observations" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # an unreadable store is no empty one
        sweep.refresh(spark, str(tmp_path / "t"), count)(rows, 0)


def test_suppression_is_the_greedy_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "s", float(rng.integers(0, 9)), float(rng.uniform(0, 40)), float(rng.uniform(0, 40))) for i in range(150)]
    kept: list = []
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        if all(np.hypot(r[3] - k[3], r[4] - k[4]) > 6 for k in kept):
            kept.append(r)
    frame = spark.createDataFrame(rows, "obs_id long, scene_id string, confidence double, x double, y double")
    assert sorted(r["obs_id"] for r in raster.suppress(frame, ["scene_id"], 6.0).collect()) == sorted(k[0] for k in kept)


def test_medians_are_exact(spark):
    from orbweave.operators import medians

    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.normal(size=501)] + [0.5] * 300
    frame = spark.createDataFrame([(v, None if i % 3 else v, None) for i, v in enumerate(values)], "a double, b double, c double")
    was, medians.ACCURACY = medians.ACCURACY, 100  # brackets of a few ranks instead of everything
    try:
        found = medians.medians(frame, {c: F.col(c) for c in "abc"})
    finally:
        medians.ACCURACY = was
    assert found == {"a": (float(np.median(values)), 801), "b": (float(np.median(values[::3])), 267), "c": (None, 0)}


def test_prefix_z_against_numpy(spark):
    from orbweave.operators.windows import prefix_robust_z

    rng = np.random.default_rng(3)
    values = rng.integers(0, 30, 60).tolist()
    frame = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, i long, n long")
    for r in prefix_robust_z(frame, ["s"], ["i"], "n").collect():
        h = np.array(values[: r["i"]], float)
        med = np.median(h)
        assert r["median"] == med and r["z"] == pytest.approx((r["n"] - med) / (np.median(np.abs(h - med)) * 1.4826 + np.sqrt(max(med, 1))))


def test_site_refresh_and_guarded_runs(spark, tmp_path):
    from orbweave.operators import refresh

    rows = [sight(1, 0), sight(2, 2, north=8), sight(3, 4, north=3000, length=260.0), sight(4, 6, north=3000, length=260.0)]
    obs = spark.createDataFrame(rows, OBS)
    scenes = obs.select("scene_id", "site", "time", F.lit(1.0).alias("clear"))
    out = refresh.refresh_sites(obs, scenes, None, 4e8)
    assert out["links"].where("chosen = 1").count() == 4 and out["tracks"].count() >= 2
    assert {r["kind"] for r in out["events"].collect()} >= {"arrival"}
    again = refresh.refresh_sites(obs, scenes, None, 4e8)
    assert sorted(r["event_id"] for r in out["events"].collect()) == sorted(r["event_id"] for r in again["events"].collect())
    root = str(tmp_path / "runs")
    wanted = scenes.select("site", "scene_id", F.lit("ships").alias("detector"))
    detect = lambda todo: obs.join(todo.select("scene_id"), "scene_id", "left_semi")
    assert refresh.process(spark, root, wanted.where("scene_id = 's0'"), detect, error="down").count() == 1
    assert refresh.process(spark, root, wanted, detect).count() == 4  # failed runs are tried again
    assert refresh.process(spark, root, wanted, detect).count() == 0
    sites = spark.createDataFrame([("old", "port", 0.0, 0.0, 1.0, 1.0)], "site string, kind string, w double, s double, e double, n double")
    preset = spark.createDataFrame([("old", "airbase", 25.0, 56.0, 10.0), ("new", "port", 26.0, 57.0, 5.0)], "site string, kind string, lat double, lon double, radius_km double")
    found = {r["site"]: r for r in refresh.add_preset(sites, preset).collect()}
    assert set(found) == {"old", "new"} and found["old"]["kind"] == "airbase" and found["new"]["w"] < 57.0 < found["new"]["e"]


def test_hull_corners_against_a_plain_search():
    from itertools import permutations

    from orbweave.operators.change import hull

    rng = np.random.default_rng(5)
    assert hull([(0, 0), (1, 1), (2, 2)]) == [] and hull([(0, 0)]) == []
    for _ in range(20):
        points = [(float(x), float(y)) for x, y in rng.integers(0, 6, (12, 2))]
        side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        # A corner begins an edge that has no point on its right, and no farther one straight on.
        edges = {(a, b) for a, b in permutations(set(points), 2) if all(side(a, b, p) > 0 or (side(a, b, p) == 0 and np.hypot(p[0] - a[0], p[1] - a[1]) + np.hypot(p[0] - b[0], p[1] - b[1]) <= np.hypot(b[0] - a[0], b[1] - a[1]) + 1e-9) for p in points)}
        assert set(hull(points)) == {a for a, _ in edges}


def test_reports_are_matched_where_they_are_found(spark):
    """Pairs are neither written nor shuffled, whatever their number; two lengths of a ship and equal seconds count as in a plain walk."""
    from datetime import datetime, timedelta

    from orbweave.operators import ais

    t0 = datetime(2024, 1, 1)
    obs = spark.createDataFrame([(i, "vessel", t0 + timedelta(seconds=500 * i), 26.0, 56.0 + i / 1000, 100.0) for i in range(12)], "obs_id long, cls string, time timestamp, lat double, lon double, length_m double")
    said = [(k % 3 if k % 7 else None, t0 + timedelta(seconds=300 * (k // 2)), 26.0 + (k % 5) / 10, 56.0 + (k % 4) / 10, 5.0, 90.0, 100.0 if k % 11 else 120.0) for k in range(60)]
    reports = spark.createDataFrame(said, "mmsi long, time timestamp, lat double, lon double, sog double, cog double, length_m double")
    near = {(i, k) for i in range(12) for k, r in enumerate(said) if abs((r[1] - t0).total_seconds() - 500 * i) <= 3600 and r[2] <= 26.25 and abs(r[3] - 56.0 - i / 1000) <= 0.25}
    found = ais.reports_near(obs, reports)
    assert {r["obs_id"]: (r["n"], r["ships"]) for r in found.collect()} == {i: (len(own), len({said[k][0] for k in own} - {None})) for i in range(12) if (own := [k for o, k in near if o == i])}
    sides = {(r["obs_id"], r["mmsi"]): (r["before"], r["after"]) for r in ais.reports_around(obs, reports).collect()}
    want = {}
    for i, k in near:
        want.setdefault((i, said[k][0]), []).append(int((said[k][1] - datetime(1970, 1, 1)).total_seconds()))
    at = lambda i: int((t0 - datetime(1970, 1, 1)).total_seconds()) + 500 * i
    assert sides == {(i, m): (max((t for t in v if t <= at(i)), default=None), min((t for t in v if t > at(i)), default=None)) for (i, m), v in want.items()}
    ships = {(i, said[k][0], max(said[q][6] for o, q in near if o == i and said[q][:2] == said[k][:2])) for i, k in near}
    assert {(r["obs_id"], r["mmsi"], r["ship_length"]) for r in ais.interpolated(obs, reports).collect()} == ships
    for rows in (found, ais.match(obs, reports)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan and "CoGroup" in plan


def test_local_minima_by_buckets_are_those_of_the_whole_series(spark):
    import numpy as np
    from orbweave.operators.windows import local_minima

    rng = np.random.default_rng(4)
    data = [(s, float(t), None if rng.random() < 0.02 else float(rng.integers(0, 40) + (30 if (t // 40) % 3 else 0))) for s in ("a", "b", None) for t in rng.permutation(900)[:700]]
    rows = spark.createDataFrame(data, "s string, t double, v double")
    whole = sorted(map(repr, local_minima(rows, ["s"], "t", "v", 25.0).collect()))
    for width in (3.0, 25.0, 1000.0):
        assert sorted(map(repr, local_minima(rows, ["s"], "t", "v", 25.0, width).collect())) == whole
