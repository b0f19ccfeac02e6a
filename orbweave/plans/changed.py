"""Queries of change detection on the two-date pixel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import change
from orbweave.operators.raster import regions
from orbweave.plans.common import Registry
from orbweave.plans.imagery import _GRID, _grid
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql

_DIAMOND = lambda n: f"(SELECT i, j FROM range(-{n}, {n + 1}) a(i), range(-{n}, {n + 1}) b(j) WHERE abs(i) + abs(j) <= {n})"
_CASE = "CASE WHEN red_b > 0.2 AND \"row\" < 16 THEN 'water_loss' WHEN red_b > 0.2 THEN 'vegetation_loss' WHEN red_b < 0.16 THEN 'burn' END"


def _kinds(spark, d):
    g = _grid(spark, d)
    kind = F.when((F.col("red_b") > 0.2) & (F.col("row") < 16), "water_loss").when(F.col("red_b") > 0.2, "vegetation_loss").when(F.col("red_b") < 0.16, "burn")
    return g.select("row", "col", kind.alias("kind"), (F.col("nir_a") * 20).alias("score"), "red_b", "red_a")


_OPEN = f"""k AS (SELECT \"row\" AS r, col AS c, {_CASE} AS kind, nir_a * 20 AS score, red_b, red_a FROM g), m AS (SELECT * FROM k WHERE kind IS NOT NULL),
er AS (SELECT kind, r + i AS r, c + j AS c FROM m, {_DIAMOND(1)} GROUP BY 1, 2, 3 HAVING count(*) = 5), op AS (SELECT DISTINCT kind, r + i AS r, c + j AS c FROM er, {_DIAMOND(1)})"""


@R.add("r8_opening", f"WITH {_GRID}, {_OPEN} SELECT kind, r, c FROM op", "pix")
def r8(spark, d):
    o = change.opened(_kinds(spark, d).where("kind is not null"), ["kind"])
    return o.select("kind", F.col("row").alias("r"), F.col("col").alias("c"))


_LABEL = f"""{_GRID}, {_OPEN}, v AS (SELECT kind, r, c, r * 64 + c AS id FROM op), ed AS (SELECT a.kind, a.id AS a, b.id AS b FROM v a JOIN v b ON a.kind = b.kind AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
l(kind, id, low) AS (SELECT kind, id, id FROM v UNION SELECT ed.kind, ed.b, l.low FROM l JOIN ed ON ed.kind = l.kind AND ed.a = l.id WHERE l.low < ed.b),
lab AS (SELECT kind, id, min(low) AS low FROM l GROUP BY 1, 2)"""
_REGIONS = f"""{_LABEL}, s AS (SELECT lab.kind, low, count(*) AS n, avg(score) AS score, var_samp(r) AS vr, var_samp(c) AS vc, covar_samp(r, c) AS rc, median(red_b) AS b, median(red_a) AS a FROM lab JOIN m ON m.kind = lab.kind AND m.r * 64 + m.c = id GROUP BY 1, 2),
z AS (SELECT *, n * 100.0::DOUBLE AS area_m2, (vr + vc) / 2 AS half, sqrt(pow((vr - vc) / 2, 2) + rc * rc) AS root FROM s WHERE n >= 6),
y AS (SELECT *, kind = 'water_loss' AND area_m2 <= 30000 AND (half - root <= 1e-9 OR sqrt((half + root) / (half - root)) >= 3) AS ship FROM z),
f AS (SELECT *, least(greatest(0.3::DOUBLE + 0.08::DOUBLE * least(score - 3, 5) + 0.08::DOUBLE * log10(greatest(area_m2 / 600, 1)) + 0.12::DOUBLE, 0.05), 0.95) AS confidence FROM y WHERE NOT coalesce(ship, false)),
reg AS (SELECT *, concat(CAST(low // 64 AS VARCHAR), '/', CAST(low % 64 AS VARCHAR)) AS label FROM f)"""


def _found(spark, d):
    return change.change_regions(_kinds(spark, d), 3.0, 10.0, 3, {"red": ("red_b", "red_a")}, 600.0)


@R.add("r8_change_regions", f"WITH {_REGIONS} SELECT kind, label, n, area_m2, round(score, 6) AS score, round(confidence, 6) AS confidence, round(b, 6) AS red_b, round(a, 6) AS red_a FROM reg ORDER BY area_m2 * confidence DESC, kind, label LIMIT 300", "pix", recursive=True)
def r8b(spark, d):
    """Opened, labelled, small and ship-shaped ones dropped, scored, with medians before and after, largest and surest first."""
    r = {c: F.round(c, 6).alias(c) for c in ("score", "confidence", "red_b", "red_a")}
    return _found(spark, d).select("kind", "label", "n", "area_m2", *r.values())


@R.add("a15_change_by_kind", f"WITH {_REGIONS}, t AS (SELECT * FROM reg ORDER BY area_m2 * confidence DESC, kind, label LIMIT 300) SELECT kind, count(*) AS regions, sum(area_m2) AS area_m2 FROM t GROUP BY kind", "pix", recursive=True)
def a15(spark, d):
    return change.by_kind(_found(spark, d))


@R.add("e11_change_events", f"WITH {_REGIONS}, t AS (SELECT * FROM reg WHERE confidence >= 0.35 ORDER BY area_m2 * confidence DESC, kind, label LIMIT 25) SELECT substr(sha1(concat('change|S1|scene|', kind, '|', label)), 1, 16) AS event_id, 'S1' AS site, concat('change_', kind) AS kind, round(least(0.25::DOUBLE + 0.35::DOUBLE * confidence + 0.05::DOUBLE * least(log10(greatest(area_m2, 1)) - 3, 2), 0.8), 2) AS severity, area_m2 FROM t", "pix", recursive=True)
def e11(spark, d):
    return change.region_events(_found(spark, d), F.lit("S1"), F.lit("scene"))


@R.add("r10_outlines", f"WITH {_LABEL} SELECT kind, concat(CAST(low // 64 AS VARCHAR), '/', CAST(low % 64 AS VARCHAR)) AS label, min(id // 64) AS top, max(id // 64) AS bottom, min(id % 64) AS first, max(id % 64) AS last FROM lab GROUP BY kind, low", "pix", recursive=True)
def r10(spark, d):
    """Convex outlines, told by their extremes here; a test holds their corners against a plain search."""
    labels = regions(change.opened(_kinds(spark, d).where("kind is not null"), ["kind"]), ["kind"])
    o = change.outlines(labels, ["kind", "label"])
    ys, xs = F.transform("outline", lambda p: p["y"].cast("long")), F.transform("outline", lambda p: p["x"].cast("long"))
    return o.select("kind", "label", F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"), F.array_min(xs).alias("first"), F.array_max(xs).alias("last"))


@R.add("r3_clear_pixels", f"WITH {_GRID}, c AS (SELECT \"row\" AS r, col AS c, CAST(floor(red_b * 1000) AS BIGINT) % 23 AS cover FROM g), bad AS (SELECT DISTINCT r + i AS r, c + j AS c FROM c, {_DIAMOND(3)} WHERE cover IN (0, 1, 3, 8, 9, 10, 11) AND (r + c) % 9 = 0) SELECT x.r, x.c, b.r IS NULL AS clear FROM (SELECT r, c FROM c) x LEFT JOIN bad b ON b.r = x.r AND b.c = x.c", "pix")
def r3(spark, d):
    cover = F.floor(F.col("red_b") * 1000) % 23
    g = _grid(spark, d).select("row", "col", F.when((F.col("row") + F.col("col")) % 9 == 0, cover).otherwise(4).alias("cover"))
    return change.clear_pixels(g, "cover").select(F.col("row").alias("r"), F.col("col").alias("c"), "clear")


_PAIRS = """u AS (SELECT scene_id, time, site AS orbit FROM scenes WHERE source = 'sentinel-1'), a AS (SELECT *, row_number() OVER (ORDER BY time DESC, scene_id) AS place FROM u WHERE time BETWEEN TIMESTAMP '2024-01-24' - INTERVAL 2 DAY AND TIMESTAMP '2024-01-25'),
b AS (SELECT u.*, row_number() OVER (ORDER BY u.orbit = a.orbit DESC, u.time DESC, u.scene_id) AS place FROM u, a WHERE a.place = 1 AND u.time BETWEEN a.time - INTERVAL 94 DAY AND a.time - INTERVAL 4 DAY),
c AS (SELECT 'after' AS role, place, scene_id FROM a UNION ALL SELECT 'before', place, scene_id FROM b)"""


def _pairs(spark, d):
    s = fx.scenes(spark, d).withColumn("orbit", F.col("site")).withColumn("coverage", F.lit(1.0))
    return change.pick_scenes(s, "sentinel-1", "2024-02-01", after="2024-01-24")


@R.add("r12_scene_pairs", f"WITH {_PAIRS} SELECT role, place, scene_id FROM c", "scenes")
def r12(spark, d):
    """Candidates after a stated day and before, those of the newest one's orbit first."""
    return _pairs(spark, d).select("role", F.col("place").cast("long").alias("place"), "scene_id")


@R.add("r13_chosen_images", f"WITH {_PAIRS}, v AS (SELECT c.*, coalesce(s.clear, 1.0) AS valid FROM c JOIN scenes s ON s.scene_id = c.scene_id), k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY place) AS n FROM v WHERE valid >= 0.3 AND place <= CASE role WHEN 'after' THEN 3 ELSE 6 END) SELECT role, scene_id FROM k WHERE n <= CASE role WHEN 'after' THEN 1 ELSE 3 END", "scenes")
def r13(spark, d):
    clear = fx.scenes(spark, d).select("scene_id", F.coalesce("clear", F.lit(1.0)).alias("valid"))
    return change.choose_images(_pairs(spark, d).join(clear, "scene_id")).select("role", "scene_id")


@R.add("r37_accepted_frames", "SELECT l_linenumber AS frame, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_tax IS NOT NULL AND l_suppkey % 11 <> 0) >= 0.8 * count(*) AND count(*) FILTER (l_suppkey % 11 <> 0 AND l_quantity * (l_linenumber + 2) > 200) <= 0.5 * count(*) FILTER (l_suppkey % 11 <> 0)", "")
def r37(spark, d):
    l = fx.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("frame"), F.when(F.col("l_suppkey") % 11 != 0, F.col("l_quantity") * (F.col("l_linenumber") + 2)).alias("v"))
    return change.frame_accepted(l, ["frame"], ["v"]).select("frame", "n")


@R.add("r32_stretched", f"WITH {_GRID} SELECT \"row\" AS r, col AS c, CAST(floor(pow(least(greatest(red_b / 0.3::DOUBLE, 0), 1), 1 / 1.4::DOUBLE) * 255) AS INTEGER) AS red FROM g", "pix")
def r32(spark, d):
    return _grid(spark, d).select(F.col("row").alias("r"), F.col("col").alias("c"), change.stretched(F.col("red_b"), 0.0, 0.3).alias("red"))


@R.add("r1_grids", "WITH k AS (SELECT scene_id, (e - w) * 111320.0::DOUBLE * cos(radians((s + n_lat) / 2)) AS wide, (n_lat - s) * 110574.0::DOUBLE AS high FROM scenes), t AS (SELECT *, greatest(10.0::DOUBLE, greatest(wide, high) / 1000) AS res FROM k) SELECT scene_id, round(res, 6) AS res, CAST(round_even(wide / res, 0) AS INTEGER) AS width, CAST(round_even(high / res, 0) AS INTEGER) AS height FROM t", "scenes")
def r1(spark, d):
    res, width, height = change.grid_of(F.col("w"), F.col("s"), F.col("e"), F.col("n_lat"), 10.0, 1000)
    return fx.scenes(spark, d).select("scene_id", F.round(res, 6).alias("res"), width.alias("width"), height.alias("height"))
