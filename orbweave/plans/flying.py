"""Queries of the airborne detector: peaks, pairs in line, movers, fuselages and the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import movers
from orbweave.operators.windows import MAD
from orbweave.plans.common import Registry
from orbweave.sources import fixtures as fx
from orbweave.sources.paths import cut

R = Registry()
QUERIES, SQL = R.queries, R.sql
SIDE, RES, BY = 72, 10.0, ["image"]
BANDS = list(movers.BAND_SECONDS)


def _each(text: str) -> str:
    return ", ".join(text.replace("#", b) for b in BANDS)


_TAPS = "taps AS (SELECT o, exp(-0.5::DOUBLE * pow(o / 3.0::DOUBLE, 2)) / sum(exp(-0.5::DOUBLE * pow(o / 3.0::DOUBLE, 2))) OVER () AS x FROM range(-12, 13) t(o))"
_Z = f"""{_TAPS},
med AS (SELECT image, {_each("median(#) AS #")} FROM bandpix GROUP BY 1), off AS MATERIALIZED (SELECT p.image, p."row" AS r, p.col AS c, {_each("p.# - m.# AS #")} FROM bandpix p JOIN med m ON m.image = p.image),
up AS (SELECT image, unnest([r, -r - 1, {2 * SIDE - 1} - r]) AS p, c, {_each("#")} FROM off), sm1 AS MATERIALIZED (SELECT image, p + o AS r, c, {_each("sum(# * x) AS #")} FROM up, taps WHERE p + o BETWEEN 0 AND {SIDE - 1} GROUP BY 1, 2, 3),
across AS (SELECT image, r, unnest([c, -c - 1, {2 * SIDE - 1} - c]) AS p, {_each("#")} FROM sm1), sm2 AS MATERIALIZED (SELECT image, r, p + o AS c, {_each("sum(# * x) AS #")} FROM across, taps WHERE p + o BETWEEN 0 AND {SIDE - 1} GROUP BY 1, 2, 3),
hi AS MATERIALIZED (SELECT o.image, o.r, o.c, {_each("o.# - s.# AS #")} FROM off o JOIN sm2 s ON s.image = o.image AND s.r = o.r AND s.c = o.c), hm AS (SELECT image, {_each("median(#) AS #")} FROM hi GROUP BY 1),
sp AS (SELECT h.image, {_each(f"median(abs(h.# - m.#)) * CAST({MAD} AS DOUBLE) AS #")} FROM hi h JOIN hm m ON m.image = h.image GROUP BY 1),
z AS MATERIALIZED (SELECT h.image, h.r, h.c, {_each("h.# / CASE WHEN s.# = 0 THEN 0.0001 ELSE s.# END AS #")} FROM hi h JOIN sp s ON s.image = h.image),
zl AS MATERIALIZED (UNPIVOT z ON blue, nir, green, red INTO NAME band VALUE z)"""
_PEAKS = f"""{_Z},
t1 AS (SELECT *, max(abs(z)) OVER (PARTITION BY image, band, r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t FROM zl), t2 AS (SELECT *, max(t) OVER (PARTITION BY image, band, c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM t1),
pk AS MATERIALIZED (SELECT p.image, p.band, p.r AS "row", p.c AS col, any_value(abs(p.z)) AS strength, sum(abs(n.z) * n.r) / sum(abs(n.z)) AS r, sum(abs(n.z) * n.c) / sum(abs(n.z)) AS c
 FROM t2 p JOIN zl n ON n.image = p.image AND n.band = p.band AND n.r BETWEEN p.r - 1 AND p.r + 1 AND n.c BETWEEN p.c - 1 AND p.c + 1 WHERE abs(p.z) = p.top AND abs(p.z) > 5 GROUP BY 1, 2, 3, 4)"""
_name = "concat(CAST({0}.\"row\" AS VARCHAR), '/', CAST({0}.col AS VARCHAR))"
_LINED = f"""{_PEAKS},
pr AS MATERIALIZED (SELECT a.image, {_name.format("a")} AS first, {_name.format("b")} AS last, a.strength, a.r AS r_blue, a.c AS c_blue, b.r AS r_red, b.c AS c_red, b.r - a.r AS dr, b.c - a.c AS dc FROM pk a JOIN pk b ON a.image = b.image AND a.band = 'blue' AND b.band = 'red'
 WHERE sqrt(pow(a.r - b.r, 2) + pow(a.c - b.c, 2)) BETWEEN {45.0 * 1.005 / RES}::DOUBLE AND {420.0 * 1.005 / RES}::DOUBLE),
told AS (SELECT image, first, last, band, r_blue + s * dr AS r, c_blue + s * dc AS c FROM pr, (VALUES ('nir', 0.264::DOUBLE / 1.005::DOUBLE), ('green', 0.527::DOUBLE / 1.005::DOUBLE)) b(band, s)),
nr AS (SELECT t.image, t.first, t.last, t.band, k.r, k.c, sqrt(pow(t.r - k.r, 2) + pow(t.c - k.c, 2)) AS d FROM told t JOIN pk k ON k.image = t.image AND k.band = t.band WHERE sqrt(pow(t.r - k.r, 2) + pow(t.c - k.c, 2)) <= 1.6::DOUBLE QUALIFY row_number() OVER (PARTITION BY t.image, t.first, t.last, t.band ORDER BY d, k.r, k.c) = 1),
li AS MATERIALIZED (SELECT pr.*, g.r AS r_green, g.c AS c_green, n.r AS r_nir, n.c AS c_nir, sqrt((g.d * g.d + n.d * n.d) / 2) AS rms FROM pr JOIN nr g ON g.image = pr.image AND g.first = pr.first AND g.last = pr.last AND g.band = 'green' JOIN nr n ON n.image = pr.image AND n.first = pr.first AND n.last = pr.last AND n.band = 'nir')"""
_apart = ", ".join(f"CASE WHEN sqrt(pow(r_{a} - r_{b}, 2) + pow(c_{a} - c_{b}, 2)) >= 3 THEN greatest(abs(s_{a}_{b}) / abs(s_{a}_{a}), abs(s_{b}_{a}) / abs(s_{b}_{b})) END" for a, b in movers.APART)
_own = ", ".join(f"abs(s_{b}_{b})" for b in BANDS)
_MOVING = f"""{_LINED},
pl AS (SELECT image, first, last, unnest(['blue', 'nir', 'green', 'red']) AS place, unnest([round_even(r_blue, 0), round_even(r_nir, 0), round_even(r_green, 0), round_even(r_red, 0)]) AS r, unnest([round_even(c_blue, 0), round_even(c_nir, 0), round_even(c_green, 0), round_even(c_red, 0)]) AS c FROM li),
sa AS (SELECT pl.image, first, last, place, {_each("arg_max(z.#, (abs(z.#), -z.r, -z.c)) AS #")} FROM pl JOIN z ON z.image = pl.image AND z.r BETWEEN pl.r - 1 AND pl.r + 1 AND z.c BETWEEN pl.c - 1 AND pl.c + 1 GROUP BY 1, 2, 3, 4),
sw AS (SELECT image, first, last, {", ".join(f"coalesce(max({b}) FILTER (place = '{a}'), 0) AS s_{a}_{b}" for a in BANDS for b in BANDS)} FROM sa GROUP BY 1, 2, 3),
mv AS MATERIALIZED (SELECT * FROM (SELECT li.*, sw.* EXCLUDE (image, first, last), coalesce(greatest(0, {_apart}), 0) AS leak FROM li JOIN sw ON sw.image = li.image AND sw.first = li.first AND sw.last = li.last)
 WHERE least({_own}) >= 4 AND greatest({_own}) <= 5 * least({_own}) AND abs({" + ".join(f"sign(s_{b}_{b})" for b in BANDS)}) = 4 AND leak <= 0.45)"""


def _z(spark, d):
    return movers.strengths(fx.band_pixels(spark, d), BY, SIDE, SIDE, near=movers.PEAK)


@R.add("r26_local_peaks", f'WITH {_PEAKS} SELECT image, band, "row", col, round(r, 5) AS r, round(c, 5) AS c, round(strength, 4) AS strength FROM pk', "bandpix")
def r26(spark, d):
    p = movers.peaks(_z(spark, d), BY)
    return p.select("image", "band", "row", "col", F.round("r", 5).alias("r"), F.round("c", 5).alias("c"), F.round("strength", 4).alias("strength"))


@R.add("j15_lined_up_peaks", f"WITH {_LINED} SELECT image, first, last, round(rms, 5) AS rms, round(r_green, 5) AS r_green, round(c_nir, 5) AS c_nir FROM li", "bandpix")
def j15(spark, d):
    p = movers.lined_up(movers.peaks(_z(spark, d), BY), BY, RES)
    return p.select("image", "first", "last", F.round("fit_rms_px", 5).alias("rms"), F.round("r_green", 5).alias("r_green"), F.round("c_nir", 5).alias("c_nir"))


def _moving(spark, d):
    z = _z(spark, d)
    return movers.moving(movers.lined_up(movers.peaks(z, BY), BY, RES), z, BY)


@R.add("r27_movers", f"WITH {_MOVING} SELECT image, first, last, round(leak, 4) AS leak FROM mv", "bandpix")
def r27(spark, d):
    return _moving(spark, d).select("image", "first", "last", F.round("leak", 4).alias("leak"))


@R.add("w15_one_to_one", f"WITH {_MOVING} SELECT image, min(first) AS first, min(last) AS last FROM mv GROUP BY image HAVING count(*) = 1", "bandpix")
def w15(spark, d):
    """Pairs of images that have but one (the forced case); a test holds all others against the plain walk."""
    moving = cut(_moving(spark, d))
    found = movers.one_to_one(moving, BY)
    alone = moving.groupBy("image").count().where("count = 1")
    return found.join(alone, "image", "left_semi").select("image", "first", "last")


_AXIS = f"""{_MOVING}, win AS MATERIALIZED (SELECT m.image, m.first, m.last, p."row" AS r, p.col AS c, p.nir AS v, round_even(m.r_blue + m.dr * (0.264::DOUBLE / 1.005::DOUBLE), 0) AS r0, round_even(m.c_blue + m.dc * (0.264::DOUBLE / 1.005::DOUBLE), 0) AS c0
 FROM mv m JOIN bandpix p ON p.image = m.image AND p."row" BETWEEN round_even(m.r_blue + m.dr * (0.264::DOUBLE / 1.005::DOUBLE), 0) - 5 AND round_even(m.r_blue + m.dr * (0.264::DOUBLE / 1.005::DOUBLE), 0) + 5 AND p.col BETWEEN round_even(m.c_blue + m.dc * (0.264::DOUBLE / 1.005::DOUBLE), 0) - 5 AND round_even(m.c_blue + m.dc * (0.264::DOUBLE / 1.005::DOUBLE), 0) + 5),
wl AS (SELECT image, first, last, median(v) AS m FROM win GROUP BY 1, 2, 3), wv AS (SELECT win.* EXCLUDE (v), abs(v - m) AS v FROM win JOIN wl USING (image, first, last)),
mk AS MATERIALIZED (SELECT * FROM wv QUALIFY v > 0.5::DOUBLE * max(v) OVER (PARTITION BY image, first, last)),
grown(image, first, last, r, c) AS (SELECT image, first, last, r, c FROM mk WHERE r = r0 AND c = c0 UNION SELECT mk.image, mk.first, mk.last, mk.r, mk.c FROM grown g JOIN mk ON mk.image = g.image AND mk.first = g.first AND mk.last = g.last AND abs(mk.r - g.r) + abs(mk.c - g.c) = 1),
mo AS (SELECT image, first, last, count(*) AS n, var_samp(c) AS xx, var_samp(-r) AS yy, covar_samp(c, -r) AS xy FROM grown GROUP BY 1, 2, 3), ev AS (SELECT *, (xx + yy) / 2 AS half, sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS root FROM mo)"""


@R.add("r29_fuselages", f"WITH {_AXIS} SELECT image, first, last, round(fmod(degrees(0.5::DOUBLE * atan2(xy * 2, yy - xx)) + 180, 180), 4) AS axis_deg FROM ev WHERE n >= 8 AND half - root > 0 AND half + root >= 9 * (half - root)", "bandpix", recursive=True)
def r29(spark, d):
    a = movers.fuselages(_moving(spark, d), fx.band_pixels(spark, d), BY)
    return a.select("image", "first", "last", F.round("axis_deg", 4).alias("axis_deg"))


@R.add("k17_flying_aircraft", f"""WITH {_MOVING}, best AS (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY image, round_even(r_blue, 0), round_even(c_blue, 0) ORDER BY rms, -strength, first, last) = 1 AND row_number() OVER (PARTITION BY image, last ORDER BY rms, -strength, first, last) = 1)
SELECT image, round(r_blue + dr / 2, 4) AS "row", round(c_blue + dc / 2, 4) AS col, round(sqrt(dr * dr + dc * dc) * {RES} / 1.005::DOUBLE, 3) AS apparent_speed_ms, round(fmod(degrees(atan2(dc, -dr)) + 360, 360), 3) AS apparent_heading_deg, round(rms, 5) AS fit_rms_px FROM best""", "bandpix")
def k17(spark, d):
    """The whole detector; its pairs are such that the first walk of the SQL takes all that the matching takes."""
    a = movers.airborne(fx.band_pixels(spark, d), BY, SIDE, SIDE, RES)
    return a.select("image", F.round("row", 4).alias("row"), F.round("col", 4).alias("col"), F.round("apparent_speed_ms", 3).alias("apparent_speed_ms"), F.round("apparent_heading_deg", 3).alias("apparent_heading_deg"), F.round("fit_rms_px", 5).alias("fit_rms_px"))
