"""Raster queries over the two-date pixel table, overpasses."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import orbits, raster
from orbweave.operators.windows import MAD
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql

_GRID = "g AS (SELECT \"row\", col, " + ", ".join(f"median({b}_{s}) AS {b}_{s}" for s in "ba" for b in ("blue", "green", "red", "nir", "swir16", "swir22")) + " FROM pix GROUP BY 1, 2)"


def _grid(spark, d):
    p = fx.pixels(spark, d)
    return raster.composite(p, ["row", "col"], [c for c in p.columns if c not in ("row", "col")])


@R.add("r2_composite", f"WITH {_GRID} SELECT \"row\", col, round(red_b, 6) AS red, round(nir_a, 6) AS nir FROM g", "pix")
def r2(spark, d):
    return _grid(spark, d).select("row", "col", F.round("red_b", 6).alias("red"), F.round("nir_a", 6).alias("nir"))


@R.add("r4_multilook", f"WITH {_GRID}, s AS (SELECT \"row\" + i AS \"row\", col + j AS col, sum(red_b) AS s, count(*) AS c FROM g, range(-2, 3) a(i), range(-2, 3) b(j) GROUP BY 1, 2) SELECT g.\"row\", g.col, round(s / c, 9) AS red_b FROM g JOIN s ON g.\"row\" = s.\"row\" AND g.col = s.col WHERE c > 12.5", "pix")
def r4(spark, d):
    return raster.multilook(_grid(spark, d), "red_b").withColumn("red_b", F.round("red_b", 9))


@R.add("r5_robust_z", f"WITH {_GRID}, m AS (SELECT median(red_a - red_b) AS med FROM g), s AS (SELECT median(abs(red_a - red_b - med)) * CAST({MAD} AS DOUBLE) AS mad FROM g, m) SELECT \"row\", col, round((red_a - red_b - med) / greatest(mad, 0.01), 4) AS z FROM g, m, s", "pix")
def r5(spark, d):
    g = _grid(spark, d).withColumn("d", F.col("red_a") - F.col("red_b"))
    return raster.robust_z(g, {"d": 0.01}).select("row", "col", F.round("z_d", 4).alias("z"))


def _change_sql() -> str:
    nd = lambda a, b, s: f"({a}_{s} - {b}_{s}) / nullif({a}_{s} + {b}_{s}, 0)"
    index = ", ".join(
        f"{nd('nir', 'red', s)} AS ndvi_{s}, {nd('green', 'swir16', s)} AS mndwi_{s}, {nd('nir', 'swir22', s)} AS nbr_{s}, (blue_{s} + green_{s} + red_{s}) / 3 AS br_{s}" for s in "ba"
    )
    names = ("mndwi", "ndvi", "nbr", "br", "red", "nir", "swir16", "swir22")
    gaps = ", ".join(f"{n}_a - {n}_b AS d_{n}" for n in names)
    mask = lambda n: "both_" if n == "mndwi" else "land"
    med = ", ".join(f"median(d_{n}) FILTER ({mask(n)}) AS m_{n}" for n in names)
    mad = ", ".join(f"median(abs(d_{n} - m_{n})) FILTER ({mask(n)}) * CAST({MAD} AS DOUBLE) AS s_{n}" for n in names)
    z = ", ".join(f"(d_{n} - m_{n}) / greatest(s_{n}, {raster.FLOORS['d_' + n]}) AS z_{n}" for n in names)
    k = 1
    return f"""WITH {_GRID}, i AS (SELECT *, {index} FROM g), d AS (SELECT *, {gaps}, mndwi_b IS NOT NULL AND mndwi_a IS NOT NULL AND ndvi_b IS NOT NULL AND ndvi_a IS NOT NULL AS both_ FROM i),
e AS (SELECT *, both_ AND NOT (mndwi_b > 0.1 AND mndwi_a > 0.1) AS land FROM d), m AS (SELECT {med} FROM e), s AS (SELECT {mad} FROM e, m), z AS (SELECT *, {z} FROM e, m, s),
c AS (SELECT CASE WHEN both_ AND mndwi_b < -0.05 AND mndwi_a > 0.1 AND z_mndwi > {k} AND swir16_b > 0.12 AND swir16_a < 0.08 THEN 'new_water'
 WHEN both_ AND mndwi_b > 0.1 AND mndwi_a < -0.05 AND z_mndwi < -{k} AND swir16_a > 0.12 AND swir16_b < 0.08 THEN 'water_loss'
 WHEN land AND d_nbr < -0.27 AND ndvi_b > 0.25 AND z_nbr < -{k} AND NOT mndwi_a > 0.1 AND red_a < 0.12 AND br_a <= br_b + 0.02 THEN 'burn'
 WHEN land AND ndvi_b > 0.4 AND d_ndvi < -0.25 AND z_ndvi < -{k} AND NOT mndwi_a > 0.1 THEN 'vegetation_loss'
 WHEN land AND d_br > 0.04 AND z_br > {k} AND z_swir16 > {k} AND ndvi_a < 0.3 AND NOT mndwi_a > 0.1 THEN 'new_bright_surface'
 WHEN land AND sqrt((z_red * z_red + z_nir * z_nir + z_swir16 * z_swir16 + z_swir22 * z_swir22) / 4) > {k + 1} AND NOT mndwi_a > 0.1 AND NOT mndwi_b > 0.1 THEN 'surface_change' END AS change FROM z)
SELECT change, count(*) AS n FROM c GROUP BY change"""


@R.add("r6_change_classes", _change_sql(), "pix")
def r6(spark, d):
    return raster.optical_change(_grid(spark, d), k=1.0).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@R.add("r7_radar_change", f"WITH {_GRID}, r AS (SELECT *, coalesce(CASE WHEN red_b > 0 AND red_a > 0 THEN 10 * log10(red_a / red_b) END, 0) AS db FROM g), m AS (SELECT median(db) AS med FROM r), s AS (SELECT median(abs(db - med)) * CAST({MAD} AS DOUBLE) AS mad FROM r, m), c AS (SELECT CASE WHEN db >= 3 AND (db - med) / greatest(mad, 0.5) > 1 THEN 'radar_increase' WHEN db <= -3 AND (db - med) / greatest(mad, 0.5) < -1 THEN 'radar_decrease' END AS change FROM r, m, s) SELECT change, count(*) AS n FROM c GROUP BY change", "pix")
def r7(spark, d):
    return raster.radar_change(_grid(spark, d), "red_b", "red_a", k=1.0).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


_CELLS = f"{_GRID}, c AS (SELECT \"row\", col, \"row\" * 64 + col AS id FROM g WHERE red_b > 0.25)"


@R.add("r8_regions", f"WITH {_CELLS}, e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.\"row\" - b.\"row\") + abs(a.col - b.col) = 1), l(id, low) AS (SELECT id, id FROM c UNION SELECT e.b, l.low FROM l JOIN e ON e.a = l.id WHERE l.low < e.b), r AS (SELECT id, min(low) AS low FROM l GROUP BY id) SELECT concat(CAST(low // 64 AS VARCHAR), '/', CAST(low % 64 AS VARCHAR)) AS label, count(*) AS n FROM r GROUP BY low", "pix", recursive=True)
def r8(spark, d):
    from orbweave.sources.paths import ensure_checkpoints

    ensure_checkpoints(spark)
    cells = _grid(spark, d).where("red_b > 0.25").select("row", "col")
    return raster.regions(cells, []).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@R.add("r17_region_shapes", f"WITH {_GRID}, m AS (SELECT \"row\" // 8 AS tile, count(*) AS n, avg(\"row\") AS r, avg(col) AS c, var_pop(\"row\") AS vr, var_pop(col) AS vc, covar_pop(\"row\", col) AS rc FROM g WHERE red_b > 0.25 GROUP BY 1), x AS (SELECT *, (vr + vc) / 2 AS half, sqrt(pow((vr - vc) / 2, 2) + rc * rc) AS root FROM m) SELECT tile, n, n * 100.0::DOUBLE AS area_m2, round(sqrt(12 * (half + root)) * 10, 4) AS length_m, round(sqrt(12 * greatest(half - root, 0)) * 10, 4) AS width_m FROM x", "pix")
def r17(spark, d):
    cells = _grid(spark, d).where("red_b > 0.25").withColumn("tile", F.floor(F.col("row") / 8))
    s = raster.shape(cells, ["tile"], 10.0)
    return s.select("tile", "n", "area_m2", F.round("length_m", 4).alias("length_m"), F.round("width_m", 4).alias("width_m"))


@R.add("a22_otsu", f"WITH {_GRID}, b AS (SELECT min(nir_b) AS lo, max(nir_b) AS hi FROM g), h AS (SELECT least(CAST(floor((nir_b - lo) / ((hi - lo) / 256)) AS BIGINT), 255) AS b, lo, hi, count(*) AS n FROM g, b GROUP BY 1, 2, 3), c AS (SELECT *, lo + (b + CAST(0.5 AS DOUBLE)) * ((hi - lo) / 256) AS centre FROM h), w AS (SELECT *, sum(n) OVER o AS w0, sum(n * centre) OVER o AS m0, sum(n) OVER () AS n_all, sum(n * centre) OVER () AS m_all FROM c WINDOW o AS (ORDER BY b ROWS UNBOUNDED PRECEDING)), v AS (SELECT b, centre, m0 / w0 - (m_all - m0) / nullif(n_all - w0, 0) AS gap, w0 * (n_all - w0) AS ww FROM w) SELECT round(centre, 6) AS threshold, round(abs(gap), 6) AS separation FROM v ORDER BY round(coalesce(ww * gap * gap, 0), 6) DESC, b LIMIT 1", "pix")
def a22(spark, d):
    o = raster.otsu(_grid(spark, d), "nir_b")
    return o.select(F.round("threshold", 6).alias("threshold"), F.round("separation", 6).alias("separation"))


@R.add("a23_block_median", f"WITH {_GRID} SELECT \"row\" // 4 AS \"row\", col // 4 AS col, round(median(nir_b), 6) AS nir_b FROM g GROUP BY 1, 2", "pix")
def a23(spark, d):
    return raster.block_median(_grid(spark, d), "nir_b", 4).withColumn("nir_b", F.round("nir_b", 6))


@R.add("pf11_hull_rules", "SELECT l_orderkey, l_linenumber, NOT ((l >= 120 AND w > 0.4 * l) OR (l >= 100 AND c < 40 AND (wig > 6 OR l * w * 0.9 / (l * w) < 0.85 OR (wig > 4 AND c < 20))) OR (red < 0 OR (red < 0.02 AND c < 15)) OR (nir < 1.15 * blue AND (c < 10 OR (c < 25 AND w > 0.3 * l)))) AS keep FROM (SELECT l_orderkey, l_linenumber, CAST(40 + l_partkey % 200 AS DOUBLE) AS l, CAST(10 + l_suppkey % 80 AS DOUBLE) AS w, l_quantity AS c, CAST(l_orderkey % 9 AS DOUBLE) AS wig, l_discount AS red, l_tax AS blue, l_discount + l_tax AS nir FROM lineitem)", "")
def pf11(spark, d):
    c = F.col
    b = fx.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (40 + c("l_partkey") % 200).cast("double").alias("length_m"), (10 + c("l_suppkey") % 80).cast("double").alias("width_m"), c("l_quantity").alias("contrast"),
        (c("l_orderkey") % 9).cast("double").alias("wiggle_m"), c("l_discount").alias("red"), c("l_tax").alias("blue"), (c("l_discount") + c("l_tax")).alias("nir"),
    ).withColumn("area_m2", c("length_m") * c("width_m") * 0.9)
    return b.select("l_orderkey", "l_linenumber", raster.hull_like().alias("keep"))


def _density_sql() -> str:
    import math

    w, s, e, n = fx.SITE_BOX
    kx = math.cos(math.radians((s + n) / 2)) * 111320.0
    nx, ny = int((e - w) * kx / 300.0), int((n - s) * 110540.0 / 300.0)
    cx, cy = (e - w) * kx / nx, (n - s) * 110540.0 / ny
    taps = lambda sigma: f"(SELECT o, exp(-0.5::DOUBLE * pow(o / {sigma!r}::DOUBLE, 2)) / sum(exp(-0.5::DOUBLE * pow(o / {sigma!r}::DOUBLE, 2))) OVER () AS x FROM range(-{int(4 * sigma + 0.5)}, {int(4 * sigma + 0.5) + 1}) t(o))"
    images = lambda c, size: f"unnest([{c}, -{c} - 1, {2 * size - 1} - {c}])"
    return f"""WITH b AS (SELECT CAST(floor(({n}::DOUBLE - lat) / ({n}::DOUBLE - {s}::DOUBLE) * {ny}) AS BIGINT) AS i, CAST(floor((lon - {w}::DOUBLE) / ({e}::DOUBLE - {w}::DOUBLE) * {nx}) AS BIGINT) AS j FROM obs WHERE cls = 'vessel'),
g AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS v FROM b WHERE i BETWEEN 0 AND {ny - 1} AND j BETWEEN 0 AND {nx - 1} GROUP BY 1, 2),
p AS (SELECT {images("i", ny)} AS p, j, v FROM g), y AS (SELECT p + o AS i, j, sum(v * x) AS v FROM p, {taps(300.0 / cy)} GROUP BY 1, 2 HAVING p + o BETWEEN 0 AND {ny - 1}),
q AS (SELECT i, {images("j", nx)} AS p, v FROM y), z AS (SELECT i, p + o AS j, sum(v * x) AS v FROM q, {taps(300.0 / cx)} GROUP BY 1, 2 HAVING p + o BETWEEN 0 AND {nx - 1})
SELECT i, j, round(v / 150 / ({cx!r}::DOUBLE * {cy!r}::DOUBLE / 1e6), 4) AS density FROM z"""


@R.add("r33_density_grid", _density_sql())
def r33(spark, d):
    o = fx.observations(spark, d).where("cls = 'vessel'")
    return raster.density_grid(o, fx.SITE_BOX, 300.0, 150).select("i", "j", F.round("per_km2_per_look", 4).alias("density"))


@R.add("j16_suppressed")
def j16(spark, d):
    """Greedy suppression; a test holds it against the plain loop."""
    from orbweave.functions import geo

    o = fx.observations(spark, d).where("cls = 'vessel'")
    b = o.select("obs_id", "scene_id", "cls", F.col("value").alias("confidence"), geo.local_x(F.col("lon"), F.lit(26.1), F.lit(56.1)).alias("x"), geo.local_y(F.col("lat"), F.lit(26.1)).alias("y"))
    return raster.suppress(b, ["scene_id", "cls"], 500.0).select("obs_id", "scene_id", "cls")


_PASSES = """s AS (SELECT n_name AS sat, CASE n_nationkey % 3 WHEN 0 THEN 'sentinel-2' WHEN 1 THEN 'sentinel-1' ELSE 'landsat' END AS family, CAST(n_nationkey * 37 % 360 AS DOUBLE) AS phase FROM nation),
a AS (SELECT sat, family, phase, o_orderkey * 20.0::DOUBLE AS t, radians(o_orderkey * 20.0::DOUBLE / 5900 * 360 + phase) AS arc FROM orders, s),
e AS (SELECT sat, family, t + 1.7e9::DOUBLE AS t, degrees(asin(sin(arc) * 0.99::DOUBLE)) AS lat, fmod(fmod(degrees(atan2(sin(arc) * -0.14::DOUBLE, cos(arc))) - t / 240 + phase + 540, 360) + 360, 360) - 180 AS lon, CASE WHEN cos(arc) < 0 THEN 192.0::DOUBLE ELSE 348.0::DOUBLE END AS heading FROM a),
d AS (SELECT *, 2 * 6371.0::DOUBLE * asin(sqrt(least(pow(sin(radians(26.1::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(26.1::DOUBLE)) * pow(sin(radians(56.1::DOUBLE - lon) / 2), 2), 1))) AS km FROM e),
w AS (SELECT *, lag(km) OVER (PARTITION BY sat ORDER BY t) AS p, lead(km) OVER (PARTITION BY sat ORDER BY t) AS n FROM d),
m AS (SELECT *, fmod(fmod(fmod(degrees(atan2((56.1::DOUBLE - lon) * cos(radians((lat + 26.1::DOUBLE) / 2)) * 111320.0::DOUBLE, (26.1::DOUBLE - lat) * 110574.0::DOUBLE)) + 360, 360) - heading + 360, 360) + 360, 360) AS turn, cos(radians(heading)) < 0 AS down FROM w WHERE km < p AND km <= n AND km < 800),
u AS (SELECT *, (t - 946728000.0::DOUBLE) / 86400 AS d FROM m), g AS (SELECT *, radians(fmod(357.529::DOUBLE + 0.98560028::DOUBLE * d, 360)) AS g, 280.459::DOUBLE + 0.98564736::DOUBLE * d AS q FROM u),
l AS (SELECT *, radians(q + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(g * 2)) AS ecl, radians(23.439::DOUBLE - 0.00000036::DOUBLE * d) AS tilt FROM g),
h AS (SELECT *, asin(sin(tilt) * sin(ecl)) AS dec, radians(fmod(280.46061837::DOUBLE + 360.98564736629::DOUBLE * d, 360) + 56.1::DOUBLE) - atan2(cos(tilt) * sin(ecl), cos(ecl)) AS hour FROM l),
x AS (SELECT *, degrees(asin(sin(radians(26.1::DOUBLE)) * sin(dec) + cos(radians(26.1::DOUBLE)) * cos(dec) * cos(hour))) AS sun, CASE WHEN turn < 180 THEN 'right' ELSE 'left' END AS side FROM h),
f AS (SELECT sat, family, t, round(km, 1) AS distance_km, side, CASE WHEN down THEN 'descending' ELSE 'ascending' END AS direction, round(sun, 1) AS sun,
 CASE WHEN family = 'sentinel-1' THEN side = 'right' AND km BETWEEN 100 AND 500 ELSE km <= CASE family WHEN 'sentinel-2' THEN 145 ELSE 92.5 END AND down AND sun > 10 END AS likely FROM x)"""


def _passes(spark, d):
    """Overpasses of an ephemeris with a satellite for every nation and a moment for every order."""
    t, k = F.col("o_orderkey") * 20.0, F.col("n_nationkey")
    family = F.when(k % 3 == 0, "sentinel-2").when(k % 3 == 1, "sentinel-1").otherwise("landsat")
    sats = fx.read(spark, d, "nation").select(F.col("n_name").alias("sat"), family.alias("family"), (k * 37 % 360).cast("double").alias("phase"))
    arc = F.radians(t / 5900 * 360 + F.col("phase"))
    eph = fx.read(spark, d, "orders").crossJoin(F.broadcast(sats)).select(  # twenty-five satellites
        "sat", "family", (t + 1.7e9).alias("t"), F.degrees(F.asin(F.sin(arc) * 0.99)).alias("lat"),
        (F.pmod(F.degrees(F.atan2(F.sin(arc) * -0.14, F.cos(arc))) - t / 240 + F.col("phase") + 540, F.lit(360.0)) - 180).alias("lon"),
        F.when(F.cos(arc) < 0, 192.0).otherwise(348.0).alias("heading"),
    )
    return orbits.next_passes(eph, 26.1, 56.1)


@R.add("g1_next_passes", f"WITH {_PASSES} SELECT * FROM f ORDER BY t", "")
def g1(spark, d):
    return _passes(spark, d).orderBy("t", "sat")


@R.add("g2_next_looks", f"WITH {_PASSES} SELECT family, arg_min(sat, (t, sat)) AS sat, min(t) AS t FROM f WHERE likely GROUP BY family", "")
def g2(spark, d):
    return orbits.next_looks(_passes(spark, d)).select("family", "sat", "t")


_SOLVE = """o AS (SELECT obs_id, value * 3 AS e, value - 40 AS n, axis_deg, sin(radians(193.0::DOUBLE)) AS te, cos(radians(193.0::DOUBLE)) AS tn FROM obs WHERE cls = 'aircraft'),
c AS (SELECT *, unnest([axis_deg, axis_deg + 180]) AS h FROM o), d AS (SELECT *, sin(radians(h)) AS he, cos(radians(h)) AS hn FROM c), s AS (SELECT *, he * -tn + te * hn AS det FROM d),
g AS (SELECT obs_id, (e * -tn + te * n) / det AS speed, (he * n - hn * e) / det AS p, fmod(h, 360) AS h FROM s WHERE abs(det) >= 0.25),
b AS (SELECT obs_id, arg_min(struct_pack(speed := speed, h := h, p := greatest(p, 0)), (greatest(p, 0), speed, h)) AS r FROM g WHERE speed > 0 AND p > -5 * 0.0095::DOUBLE * 1000 GROUP BY obs_id)"""


@R.add("r30_parallax", f"WITH {_SOLVE} SELECT o.obs_id, round(r.speed, 2) AS speed_ms, r.h AS heading_deg, round(r.p / 0.0095::DOUBLE, 0) AS altitude_m FROM o LEFT JOIN b ON o.obs_id = b.obs_id")
def r30(spark, d):
    """Speed, heading and altitude from apparent velocity and axis."""
    o = fx.observations(spark, d).where("cls = 'aircraft'")
    solved = raster.parallax(F.col("value") * 3, F.col("value") - 40, F.col("axis_deg"), F.lit(193.0), 0.0095)
    return o.select("obs_id", solved.alias("s")).select("obs_id", F.round("s.speed_ms", 2).alias("speed_ms"), "s.heading_deg", F.round("s.altitude_m", 0).alias("altitude_m"))
