"""Queries over areas of embeddings, projected grids and tiled images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orbweave.functions import geo, projection
from orbweave.operators import lookalikes, tiles
from orbweave.plans.common import Registry
from orbweave.plans.imagery import _GRID, _grid
from orbweave.sources import fixtures as fx

R = Registry()
QUERIES, SQL = R.queries, R.sql
DIMS, COLS = 64, 40
#: A given basis, so that SQL can state what eigenvectors would otherwise decide.
BASIS = (np.full(DIMS, 0.02), np.diag([1 + i / DIMS for i in range(DIMS)]))
VIEW = np.zeros((DIMS, 3))
VIEW[[0, 9, 20], [0, 1, 2]] = 1.0
VIEW[[1, 10, 21], [0, 1, 2]] = -0.5


def _cells(spark, d, shift: int = 0):
    """One cell a vector, in rows of forty."""
    k = F.col("vec_id") - shift
    return fx.read(spark, d, "embeddings").select(F.floor(k / COLS).alias("row"), (k % COLS).alias("col"), "label", "embedding").where(k >= 0)


_E = f"""v AS MATERIALIZED (SELECT vec_id // {COLS} AS r, vec_id % {COLS} AS c, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS MATERIALIZED (SELECT r, c, list_transform(e, lambda x, i: (x - 0.02::DOUBLE) * (1 + (i - 1) / 64.0::DOUBLE)) AS e FROM v)"""
#: Labels of the cells of ``hot(r, c, s)``, and their regions in order of the peak.
_REGIONS = f"""ids AS MATERIALIZED (SELECT r, c, s, r * {COLS} + c AS id FROM hot), ed AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM ids a JOIN ids b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
l(id, low) AS (SELECT id, id FROM ids UNION SELECT ed.b, l.low FROM l JOIN ed ON ed.a = l.id WHERE l.low < ed.b), lab AS MATERIALIZED (SELECT ids.*, m.low FROM ids JOIN (SELECT id, min(low) AS low FROM l GROUP BY id) m USING (id))"""


def _ranked(source: str, least: int, top: int) -> str:
    return f"""reg AS (SELECT low, count(*) AS n, max(s) AS peak, arg_max(r, (s, -r, -c)) AS pr, arg_max(c, (s, -r, -c)) AS pc, min(r) AS r0, max(c) AS c1 FROM {source} GROUP BY low HAVING count(*) >= {least})
SELECT row_number() OVER (ORDER BY peak DESC, pr, pc) AS place, n, round(peak, 6) AS peak, pr AS "row", pc AS col, r0, c1 FROM reg ORDER BY place LIMIT {top}"""


def _shown(found):
    return found.select("place", "n", F.round("peak", 6).alias("peak"), "row", "col", "r0", "c1")


@R.add("v8_score_regions", f"WITH RECURSIVE {_E}, hot AS (SELECT r, c, e[1] AS s FROM v WHERE e[1] > 0.02), {_REGIONS}, {_ranked('lab', 2, 50)}", "")
def v8(spark, d):
    s = _cells(spark, d).withColumn("score", F.get("embedding", F.lit(0)).cast("double"))
    return _shown(lookalikes.score_regions(s, [], "score", F.col("score") > 0.02))


_EXAMPLE = 7
_SIMILAR = f"""{_E}, ex AS (SELECT e AS q FROM w WHERE r = 0 AND c = {_EXAMPLE}), hot AS (SELECT r, c, list_cosine_similarity(e, q) AS s FROM w, ex WHERE list_cosine_similarity(e, q) >= 0.0), {_REGIONS},
own AS (SELECT DISTINCT low FROM lab WHERE r <= 1 AND c BETWEEN {_EXAMPLE - 1} AND {_EXAMPLE + 1}), finds AS (SELECT * FROM lab WHERE low NOT IN (SELECT low FROM own)), {_ranked('finds', 2, 50)}"""


@R.add("v4_find_similar", f"WITH RECURSIVE {_SIMILAR}", "")
def v4(spark, d):
    """Cells like the seventh in a given basis; a cell is 100 m, so an example's own reach is one cell."""
    cells = _cells(spark, d)
    found, _ = lookalikes.find_similar(cells, "embedding", cells.where(f"row = 0 and col = {_EXAMPLE}"), 100.0, basis=BASIS, threshold=0.0)
    return _shown(found)


@R.add("k15_find_similar_probe")
def k15(spark, d):
    """Three examples of label 3 and two of others by the probe; weights come from descent, so a test holds it against NumPy."""
    cells = _cells(spark, d)
    pick = lambda rows, n: rows.orderBy("row", "col").limit(n)
    found, _ = lookalikes.find_similar(cells, "embedding", pick(cells.where("label = 3"), 3), 100.0, negatives=pick(cells.where("label <> 3"), 2), threshold=0.5, least_px=1)
    return _shown(found)


@R.add("k16_semantic_change", f"""WITH RECURSIVE {_E}, p AS (SELECT a.r, a.c, 1 - list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON b.r * {COLS} + b.c = a.r * {COLS} + a.c + 1), m AS (SELECT median(s) AS med FROM p), x AS (SELECT median(abs(s - med)) * CAST(1.4826 AS DOUBLE) AS mad FROM p, m),
hot AS (SELECT r, c, s FROM p, m, x WHERE (s - med) / greatest(mad, 0.01) > 0.2 AND s > 0.15), {_REGIONS}, {_ranked('lab', 3, 40)}""", "")
def k16(spark, d):
    """Every vector against the next: regions of cells that turned most, on a coarse grid, so nothing is opened away."""
    found, _ = lookalikes.semantic_change(_cells(spark, d), _cells(spark, d, 1), "embedding", 30.0, k=0.2)
    return _shown(found)


_PROJECTED = "pj AS MATERIALIZED (SELECT r, c, " + ", ".join(f"(e[{a + 1}] - 0.02::DOUBLE) - 0.5::DOUBLE * (e[{a + 2}] - 0.02::DOUBLE) AS p{k}" for k, a in enumerate((0, 9, 20))) + " FROM v)"
_BYTE = lambda k: f"CAST(floor(greatest(least((p{k} - l{k}) / greatest(h{k} - l{k}, 1e-6), 1), 0) * 255) AS INTEGER)"


@R.add("v6_embedding_view", f"WITH {_E}, {_PROJECTED}, q AS (SELECT " + ", ".join(f"quantile_cont(p{k}, 0.02) AS l{k}, quantile_cont(p{k}, 0.98) AS h{k}" for k in range(3)) + f" FROM pj) SELECT r AS \"row\", c AS col, {_BYTE(0)} AS red, {_BYTE(1)} AS green, {_BYTE(2)} AS blue FROM pj, q", "")
def v6(spark, d):
    """Three given directions as colours, stretched between exact percentiles."""
    return lookalikes.embedding_view(_cells(spark, d), "embedding", DIMS, (BASIS[0], VIEW))


@R.add("v6_principal_view")
def v6_principal(spark, d):
    """The same on the principal axes; they come from the driver's eigenvectors, so a test holds it against NumPy."""
    return lookalikes.embedding_view(_cells(spark, d), "embedding", DIMS)


@R.add("r34_feathered_tiles", f"WITH {_GRID} SELECT i AS \"row\", j AS col, round(coalesce(red_b, 0), 9) AS red, round(coalesce(nir_a, 0), 9) AS nir FROM range(128) a(i) CROSS JOIN range(128) b(j) LEFT JOIN g ON g.\"row\" = i // 2 AND g.col = j // 2", "pix")
def r34(spark, d):
    """Tiles of 24 that overlap by 8, made twice as fine by repeating cells and blended: the image again."""
    twice = lambda t: t.repeat(2, axis=1).repeat(2, axis=2)
    g = _grid(spark, d).select("row", "col", F.col("red_b").alias("red"), F.col("nir_a").alias("nir"))
    return tiles.feathered(g, [], ["red", "nir"], 64, 64, twice, patch=24, overlap=4, scale=2).select("row", "col", F.round("red", 9).alias("red"), F.round("nir", 9).alias("nir"))


def _forward(lat: str, lon: str, cm: str) -> str:
    """The projection's series in SQL: columns ``ea`` and ``no`` of the northern zone."""
    x = "".join(f" + {a!r}::DOUBLE * sin({2 * j} * x1) * cosh({2 * j} * y1)" for j, a in enumerate(projection.FORWARD, 1))
    y = "".join(f" + {a!r}::DOUBLE * cos({2 * j} * x1) * sinh({2 * j} * y1)" for j, a in enumerate(projection.FORWARD, 1))
    return f"""t0 AS (SELECT *, sinh(atanh(sin(radians({lat}))) - {projection._ECC!r}::DOUBLE * atanh({projection._ECC!r}::DOUBLE * sin(radians({lat})))) AS t, radians({lon}) - radians({cm}) AS dl FROM src),
t1 AS (SELECT *, atan2(t, cos(dl)) AS x1, asinh(sin(dl) / sqrt(t * t + pow(cos(dl), 2))) AS y1 FROM t0), t2 AS (SELECT *, {projection._A!r}::DOUBLE * (y1{y}) + 500000 AS ea, {projection._A!r}::DOUBLE * (x1{x}) AS no FROM t1)"""


_ZONE = "(floor((lon + 180) / 6) % 60 + 1)"


@R.add("f12_projected_points", f"WITH src AS (SELECT obs_id, lat, lon FROM obs), {_forward('lat', 'lon', f'{_ZONE} * 6 - 183')} SELECT obs_id, round(ea, 4) AS east, round(no, 4) AS north, round(lat, 9) AS lat, round(lon, 9) AS lon FROM t2")
def f12_projected(spark, d):
    """Sightings in metres of their zone, and back again."""
    o = fx.observations(spark, d).withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon")))
    east, north = projection.to_utm(F.col("lat"), F.col("lon"), F.col("epsg"))
    rows = o.select("obs_id", "epsg", east.alias("east"), north.alias("north"))
    lat, lon = projection.from_utm(F.col("east"), F.col("north"), F.col("epsg"))
    return rows.select("obs_id", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


_SIDES = "src AS (SELECT scene_id, lon, lat, floor(((w + e) / 2 + 180) / 6) % 60 + 1 AS zone FROM scenes, (SELECT k / 22.0::DOUBLE AS f FROM range(23) t(k)), LATERAL (VALUES (w + (e - w) * f, s), (w + (e - w) * f, n_lat), (w, s + (n_lat - s) * f), (e, s + (n_lat - s) * f)) p(lon, lat))"


@R.add("r1_projected_grids", f"WITH {_SIDES}, {_forward('lat', 'lon', 'zone * 6 - 183')}, b AS (SELECT scene_id, min(ea) AS x0, min(no) AS y0, max(ea) AS x1, max(no) AS y1 FROM t2 GROUP BY 1), g AS (SELECT *, greatest(10.0::DOUBLE, (x1 - x0) / 1000, (y1 - y0) / 1000) AS res FROM b) SELECT scene_id, round(x0, 3) AS x0, round(y1, 3) AS y1, round(res, 6) AS res, CAST(ceil(round((x1 - x0) / res, 9)) AS BIGINT) AS width, CAST(ceil(round((y1 - y0) / res, 9)) AS BIGINT) AS height FROM g", "scenes")
def r1_projected(spark, d):
    """Grids in the zone of each scene, coarser where a side would exceed a thousand pixels."""
    s = fx.scenes(spark, d)
    epsg = geo.utm_epsg((F.col("s") + F.col("n_lat")) / 2, (F.col("w") + F.col("e")) / 2)
    g = projection.grid_for(F.col("w"), F.col("s"), F.col("e"), F.col("n_lat"), F.col("epsg"), 10.0, 1000)
    rows = s.withColumn("epsg", epsg).select("scene_id", g.alias("g"))
    return rows.select("scene_id", F.round("g.x0", 3).alias("x0"), F.round("g.y1", 3).alias("y1"), F.round("g.res", 6).alias("res"), "g.width", "g.height")


def _back(e: str, n: str) -> str:
    u = "".join(f" - {b!r}::DOUBLE * sin({2 * j} * x) * cosh({2 * j} * y)" for j, b in enumerate(projection.INVERSE, 1))
    v = "".join(f" - {b!r}::DOUBLE * cos({2 * j} * x) * sinh({2 * j} * y)" for j, b in enumerate(projection.INVERSE, 1))
    more = "".join(f" + {c!r}::DOUBLE * sin({2 * j} * q)" for j, c in enumerate(projection.LATITUDE, 1))
    return f"""b0 AS (SELECT *, {n} / {projection._A!r}::DOUBLE AS x, ({e} - 500000) / {projection._A!r}::DOUBLE AS y FROM src), b1 AS (SELECT *, x{u} AS u, y{v} AS v FROM b0), b2 AS (SELECT *, atan2(sin(u), sqrt(pow(sinh(v), 2) + pow(cos(u), 2))) AS q FROM b1),
b3 AS (SELECT *, degrees(q{more}) AS lat, degrees(atan2(sinh(v), cos(u)) + radians(zone * 6 - 183)) AS lon FROM b2)"""


_KEYS = """keys AS (SELECT DISTINCT l_orderkey % 4096 AS k FROM lineitem), xy AS (SELECT k, 33 + k % 8 AS zone, 30 + (k % 8) AS tx, 20 + (k // 8) % 24 AS ty FROM keys),
bx AS (SELECT *, -9740000.0::DOUBLE + tx * 320000.0::DOUBLE AS x0, 10240000.0::DOUBLE - ty * 320000.0::DOUBLE AS y1 FROM xy),
src AS (SELECT k, zone, ea, no FROM bx, (SELECT i / 6.0::DOUBLE AS f FROM range(7) t(i)), LATERAL (VALUES (x0 + 320000 * f, y1 - 320000), (x0 + 320000 * f, y1), (x0, y1 - 320000 + 320000 * f), (x0 + 320000, y1 - 320000 + 320000 * f)) p(ea, no))"""


@R.add("f15_tile_boxes", f"WITH {_KEYS}, {_back('ea', 'no')} SELECT k, round(min(lon), 7) AS w, round(min(lat), 7) AS s, round(max(lon), 7) AS e, round(max(lat), 7) AS n FROM b3 GROUP BY k", "")
def f15_boxes(spark, d):
    """Boxes in degrees of tiles of the zone's quadtree, from their quadkeys."""
    k = fx.read(spark, d, "lineitem").select((F.col("l_orderkey") % 4096).alias("k")).distinct()
    tx, ty = 30 + F.col("k") % 8, 20 + F.floor(F.col("k") / 8) % 24
    digit = lambda i: (F.shiftright(tx.cast("long"), i).bitwiseAND(1) + F.shiftright(ty.cast("long"), i).bitwiseAND(1) * 2).cast("string")
    rows = k.select("k", (32633 + F.col("k") % 8).alias("epsg"), F.concat(*[digit(i) for i in range(5, -1, -1)]).alias("key"))
    box = dict(zip(("x0", "y0", "x1", "y1"), geo.quadkey_box(F.col("key")), strict=True))
    w, s, e, n = projection.box_from_utm(*[F.col(c) for c in box], F.col("epsg"))
    return rows.withColumns(box).select("k", F.round(w, 7).alias("w"), F.round(s, 7).alias("s"), F.round(e, 7).alias("e"), F.round(n, 7).alias("n"))
