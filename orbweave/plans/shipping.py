"""Queries of the ship detector's steps on the pixel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import ships
from orbweave.plans.changed import _DIAMOND
from orbweave.plans.common import Registry
from orbweave.plans.imagery import _GRID, _grid
from orbweave.sources import fixtures as fx
from orbweave.sources.paths import cut

R = Registry()
QUERIES, SQL = R.queries, R.sql
SIDE, RES = 64, 10.0
_SCL = "CASE WHEN swir16_b > 0.197 THEN 6 WHEN swir16_b < 0.17 THEN 9 ELSE 5 END"


def _image(spark, d):
    g = _grid(spark, d)
    scl = F.when(F.col("swir16_b") > 0.197, 6).when(F.col("swir16_b") < 0.17, 9).otherwise(5)
    return cut(g.select("row", "col", *[F.col(f"{b}_b").alias(b) for b in ("nir", "green", "red", "blue")], scl.alias("scl")))


def _masks(spark, d):
    return cut(ships.optical_masks(_image(spark, d), SIDE, SIDE, 0.2, 8, 2, 40))


def _labels(name: str, cells: str, diagonal: bool = False) -> str:
    near = "greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1" if diagonal else "abs(a.r - b.r) + abs(a.c - b.c) = 1"
    return f"""e_{name} AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM {cells} a JOIN {cells} b ON {near}),
l_{name}(id, low) AS (SELECT id, id FROM {cells} UNION SELECT e_{name}.b, l.low FROM l_{name} l JOIN e_{name} ON e_{name}.a = l.id WHERE l.low < e_{name}.b),
{name} AS MATERIALIZED (SELECT id, id // 64 AS r, id % 64 AS c, min(low) AS low FROM l_{name} GROUP BY id)"""


_MASK = f"""i AS MATERIALIZED (SELECT \"row\" AS r, col AS c, \"row\" * 64 + col AS id, nir_b AS nir, green_b AS green, red_b AS red, blue_b AS blue, {_SCL} AS scl FROM g),
x AS MATERIALIZED (SELECT *, scl = 6 AS water, coalesce((nir - red) / nullif(nir + red, 0), 0) > 0.2 AS plant FROM i), cc AS (SELECT r, c, id FROM x WHERE scl = 9), dry AS (SELECT r, c, id FROM x WHERE NOT water),
{_labels("cl", "cc")}, {_labels("ho", "dry")},
cloud AS MATERIALIZED (SELECT DISTINCT r + i AS r, c + j AS c FROM cl, {_DIAMOND(2)} WHERE low IN (SELECT low FROM cl GROUP BY low HAVING count(*) > 8)),
hole AS MATERIALIZED (SELECT r, c FROM ho WHERE low IN (SELECT low FROM ho JOIN x USING (id) GROUP BY low HAVING count(*) <= 40 AND count(*) FILTER (ho.r IN (0, 63) OR ho.c IN (0, 63)) = 0 AND count(*) FILTER (plant) <= 0.2 * count(*))),
mk AS MATERIALIZED (SELECT x.*, (water OR h.r IS NOT NULL) AND k.r IS NULL AS sea, k.r IS NOT NULL AS cloud, NOT (water OR h.r IS NOT NULL) AND k.r IS NULL AS land FROM x LEFT JOIN cloud k ON k.r = x.r AND k.c = x.c LEFT JOIN hole h ON h.r = x.r AND h.c = x.c)"""


@R.add("r14_masks", f"WITH {_GRID}, {_MASK} SELECT r, c, sea, cloud, land FROM mk", "pix", recursive=True)
def r14(spark, d):
    return _masks(spark, d).select(F.col("row").alias("r"), F.col("col").alias("c"), "sea", "cloud", "land")


@R.add("r15_small_holes", f"WITH {_GRID}, {_MASK} SELECT r, c FROM hole", "pix", recursive=True)
def r15(spark, d):
    nd = F.coalesce(F.try_divide(F.col("nir") - F.col("red"), F.col("nir") + F.col("red")), F.lit(0.0))
    i = _image(spark, d).withColumn("water", F.col("scl") == 6).withColumn("plant", nd > 0.2)
    return ships.small_holes(i, "water", "plant", SIDE, SIDE, 40).select(F.col("row").alias("r"), F.col("col").alias("c"))


_TAPS = "(SELECT o, exp(-0.5::DOUBLE * pow(o / 6.0::DOUBLE, 2)) / sum(exp(-0.5::DOUBLE * pow(o / 6.0::DOUBLE, 2))) OVER () AS x FROM range(-24, 25) t(o))"
_SMOOTH = f"""md AS (SELECT median(nir) AS med FROM mk WHERE sea), sp AS MATERIALIZED (SELECT median(abs(nir - med)) * 1.4826::DOUBLE + 1e-9::DOUBLE AS mad, any_value(med) AS med FROM mk, md WHERE sea),
w0 AS (SELECT r, c, CAST(sea AS DOUBLE) AS w, CASE WHEN sea THEN least(nir, med + 3 * mad) ELSE 0 END AS v FROM mk, sp),
w1 AS (SELECT unnest([r, -r - 1, 127 - r]) AS p, c, w, v FROM w0), w2 AS MATERIALIZED (SELECT p + o AS r, c, sum(w * x) AS w, sum(v * x) AS v, sum(v * v * x) AS vv FROM w1, {_TAPS} GROUP BY 1, 2 HAVING p + o BETWEEN 0 AND 63),
w3 AS (SELECT r, unnest([c, -c - 1, 127 - c]) AS p, w, v, vv FROM w2), w4 AS MATERIALIZED (SELECT r, p + o AS c, sum(w * x) AS w, sum(v * x) AS v, sum(vv * x) AS vv FROM w3, {_TAPS} GROUP BY 1, 2 HAVING p + o BETWEEN 0 AND 63),
ct AS MATERIALIZED (SELECT mk.*, coalesce(nir - s.v / (s.w + 1e-6::DOUBLE), 0) AS excess, sqrt(greatest(s.vv / (s.w + 1e-6::DOUBLE) - pow(s.v / (s.w + 1e-6::DOUBLE), 2), pow(0.5::DOUBLE * mad, 2))) AS std FROM mk JOIN w4 s ON s.r = mk.r AND s.c = mk.c, sp)"""


def _contrast(spark, d):
    return ships.contrasted(_masks(spark, d), "nir", 60.0, RES, SIDE, SIDE)


@R.add("r16_contrast", f"WITH {_GRID}, {_MASK}, {_SMOOTH} SELECT r, c, round(excess, 7) AS excess, round(std, 7) AS std FROM ct", "pix", recursive=True)
def r16(spark, d):
    return _contrast(spark, d).select(F.col("row").alias("r"), F.col("col").alias("c"), F.round("excess", 7).alias("excess"), F.round("std", 7).alias("std"))


@R.add("r21_owned_by_core", "SELECT l_orderkey, l_linenumber, (l_orderkey % 640) // 64 AS tile_row FROM lineitem", "")
def r21(spark, d):
    """Every detection is reported by its tile and by both row neighbours, and kept by the tile whose core holds its centre."""
    l = fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 640).alias("row"), (F.col("l_partkey") % 640).alias("col"))
    near = l.withColumn("tile_row", F.explode(F.array(*[F.floor(F.col("row") / 64) + i for i in (-1, 0, 1)]))).withColumn("tile_col", F.floor(F.col("col") / 64))
    return ships.owned(near, 64).select("l_orderkey", "l_linenumber", "tile_row")


_DB = f"""db AS (SELECT \"row\" AS r, col AS c, CASE WHEN \"row\" < 24 THEN -20 ELSE -4 END + nir_b * 4 AS db FROM g), co AS (SELECT r // 4 AS r, c // 4 AS c, median(db) AS db FROM db GROUP BY 1, 2),
bb AS (SELECT min(db) AS lo, max(db) AS hi FROM co), hh AS (SELECT least(CAST(floor((db - lo) / ((hi - lo) / 256)) AS BIGINT), 255) AS b, lo, hi, count(*) AS n FROM co, bb GROUP BY 1, 2, 3), hc AS (SELECT *, lo + (b + CAST(0.5 AS DOUBLE)) * ((hi - lo) / 256) AS centre FROM hh),
hw AS (SELECT *, sum(n) OVER o AS w0, sum(n * centre) OVER o AS m0, sum(n) OVER () AS n_all, sum(n * centre) OVER () AS m_all FROM hc WINDOW o AS (ORDER BY b ROWS UNBOUNDED PRECEDING)), hv AS (SELECT b, centre, m0 / w0 - (m_all - m0) / nullif(n_all - w0, 0) AS gap, w0 * (n_all - w0) AS ww FROM hw),
th AS (SELECT CASE WHEN abs(gap) < 5 THEN -14 ELSE centre END AS thr FROM hv ORDER BY round(coalesce(ww * gap * gap, 0), 6) DESC, b LIMIT 1), wet AS (SELECT r, c FROM co, th WHERE db < thr),
we1 AS (SELECT r + i AS r, c + j AS c FROM wet, {_DIAMOND(1)} GROUP BY 1, 2 HAVING count(*) = 5), we2 AS (SELECT DISTINCT r + i AS r, c + j AS c FROM we1, {_DIAMOND(1)})"""


@R.add("r22_radar_water", f"WITH {_GRID}, {_DB} SELECT db.r, db.c FROM db JOIN we2 ON we2.r = db.r // 4 AND we2.c = db.c // 4", "pix")
def r22(spark, d):
    db = F.when(F.col("row") < 24, -20).otherwise(-4) + F.col("nir_b") * 4
    return ships.radar_water(_grid(spark, d).select("row", "col", db.alias("db")), "db", 4, True).select(F.col("row").alias("r"), F.col("col").alias("c"))
