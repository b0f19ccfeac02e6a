"""Aircraft in flight from the time between a push-broom sensor's bands.

What stands still lies at one place in all bands; what moves lies on a line, spaced as the bands are in
time. Peaks of every band are paired by their distance, the line between a first and a last place
foretells the two places between, and a pair counts if peaks are there and each band shows
nothing at the others' places. Many images go at once; ``by`` names the columns that tell them apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.joins import range_join
from orbweave.operators.matching import greedy_matching
from orbweave.operators.medians import quantiles
from orbweave.operators.raster import parallax, regions
from orbweave.operators.ships import gaussian, smoothed
from orbweave.operators.windows import MAD
from orbweave.sources.paths import cut

# Seconds of each band after the first, apparent speeds that are looked for (m/s), apparent
# shift (m/s) a metre of height, strength of a peak in deviations, what bands are told apart, and the
# limits of the tests for movers, fuselages and plausible solutions.
BAND_SECONDS = {"blue": 0.0, "nir": 0.264, "green": 0.527, "red": 1.005}
LEAST_SPEED, MOST_SPEED = 45.0, 420.0
SHIFT_PER_M = 6630.0 / 786_000.0
PEAK, SMOOTHING_PX, LEAST_MAD = 5.0, 3.0, 1e-4
APART = (("blue", "green"), ("blue", "red"), ("nir", "red"), ("green", "red"), ("nir", "blue"))
FIT_PX, OVERLAP_PX, MOST_LEAK, MOST_RATIO = 1.6, 3.0, 0.45, 5.0
AXIS_REACH, AXIS_PX, AXIS_RATIO = 5, 8, 9.0
MOST_HEIGHT_M, MOST_TRUE_SPEED, CRUISE_M = 16_000.0, 330.0, 11_000.0
#: Images of up to so many pixels are a group each; larger ones go by joins and strips of lines.
GROUP_PX = 1 << 20
#: Pixels around a strong one that peaks and samples at their places look at.
AROUND_PX = 2


def strengths(pixels: DataFrame, by: list[str], height: int, width: int, bands: list[str] = tuple(BAND_SECONDS), near: float | None = None) -> DataFrame:
    """``z_<band>`` of every pixel that all bands have: what is left of a band less its Gaussian mean, in robust deviations of its image.

    Missing values (null, NaN, absent pixels) count as the band's median in the mean and as nothing else. With ``near``,
    only pixels within ``AROUND_PX`` of one that is stronger than that in any band: all that ``peaks`` of that strength and ``moving`` look at.
    """
    bands = list(bands)
    if by and height * width <= GROUP_PX:
        return cut(_strengths_by_image(pixels, by, height, width, bands, near))
    z = _strengths_by_strips(pixels, by, height, width, bands)
    if near is None:
        return z
    strong = z.where(F.greatest(*[F.abs(f"z_{b}") for b in bands]) > near).select(*by, "row", "col")
    kept = _around(strong, by, "row", "col", AROUND_PX).select(*by, "row", "col").distinct()
    return cut(z.join(kept, [*by, "row", "col"], "left_semi"))


def _strengths_by_image(pixels: DataFrame, by: list[str], height: int, width: int, bands: list[str], near: float | None) -> DataFrame:
    rows = pixels.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.col(b).cast("double").alias(b) for b in bands]).dropna(subset=[*by, "row", "col"])
    kernel = gaussian(SMOOTHING_PX)
    reach = len(kernel) // 2
    # Mirrored edges; an image may be narrower than the kernel.
    mirrored = lambda n: np.abs((np.arange(-reach, n + reach) + 0.5) % (2 * n) - n)
    inner = {n: (n - 0.5 - mirrored(n)).astype(int) for n in (height, width)}

    def run(table: pa.Table) -> pa.Table:
        r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
        inside = (r >= 0) & (r < height) & (c >= 0) & (c < width)
        raw = {b: table.column(b).to_numpy() for b in bands}
        whole = inside & np.all([~np.isnan(v) for v in raw.values()], axis=0)
        z, strong = {}, np.zeros((height + 2 * AROUND_PX, width + 2 * AROUND_PX), dtype=bool)
        for b, v in raw.items() if whole.any() else ():
            off = v - np.median(v[~np.isnan(v)])
            dense = np.zeros((height, width))
            dense[r[inside], c[inside]] = np.nan_to_num(off[inside], nan=0.0, posinf=np.inf, neginf=-np.inf)
            wide = sum(k * dense[inner[height][i : i + height]] for i, k in enumerate(kernel))
            wide = sum(k * wide[:, inner[width][i : i + width]] for i, k in enumerate(kernel))
            high = off[whole] - wide[r[whole], c[whole]]
            spread = np.median(np.abs(high - np.median(high)))
            z[b] = high / (LEAST_MAD if spread == 0 else spread * MAD)
            over = np.zeros(len(high), dtype=bool) if near is None else ~(np.abs(z[b]) <= near)
            strong[r[whole][over] + AROUND_PX, c[whole][over] + AROUND_PX] = True
        taken = np.flatnonzero(whole)
        if near is not None and len(taken):
            steps = range(2 * AROUND_PX + 1)
            close = np.any([strong[i : i + height, j : j + width] for i in steps for j in steps], axis=0)
            shown = close[r[taken], c[taken]]
            taken, z = taken[shown], {b: v[shown] for b, v in z.items()}
        out = table.select([*by, "row", "col"]).take(pa.array(taken))
        for b in bands:
            out = out.append_column(f"z_{b}", pa.array(z.get(b, np.zeros(0))))
        return out

    kinds = [f"`{n}` {t}" for n, t in rows.select(*by, "row", "col").dtypes] + [f"z_{b} double" for b in bands]
    return rows.groupBy(*by).applyInArrow(run, ", ".join(kinds))


def _strengths_by_strips(pixels: DataFrame, by: list[str], height: int, width: int, bands: list[str]) -> DataFrame:
    known = lambda b: F.when(~F.isnan(F.col(b).cast("double")), F.col(b).cast("double"))
    rows = cut(pixels.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[known(b).alias(b) for b in bands]))
    middle = _wide(quantiles(rows, {b: F.col(b) for b in bands}, [0.5], by), by, bands, "_m_")
    off = cut(_with(rows, middle, by).select(*by, "row", "col", *[F.col(b).isNull().alias(f"_no_{b}") for b in bands], *[F.coalesce(F.col(b) - F.col(f"_m_{b}"), F.lit(0.0)).alias(b) for b in bands]))
    wide = smoothed(off, bands, SMOOTHING_PX, height, width, by).withColumnsRenamed({b: f"_g_{b}" for b in bands})
    none = F.lit(False)
    for b in bands:
        none = none | F.col(f"_no_{b}")
    high = cut(off.where(~none).join(wide, [*by, "row", "col"]).select(*by, "row", "col", *[(F.col(b) - F.col(f"_g_{b}")).alias(b) for b in bands]))
    centre = _wide(quantiles(high, {b: F.col(b) for b in bands}, [0.5], by), by, bands, "_m_")
    gaps = _with(high, centre, by)
    spread = _wide(quantiles(gaps, {b: F.abs(F.col(b) - F.col(f"_m_{b}")) for b in bands}, [0.5], by), by, bands, "_s_")
    unit = lambda b: F.when(F.col(f"_s_{b}") == 0, F.lit(LEAST_MAD)).otherwise(F.col(f"_s_{b}") * MAD)
    return cut(_with(high, spread, by).select(*by, "row", "col", *[(F.col(b) / unit(b)).alias(f"z_{b}") for b in bands]))


def _wide(found: DataFrame, by: list[str], bands: list[str], mark: str) -> DataFrame:
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == b, F.col("value"))).alias(f"{mark}{b}") for b in bands])


def _with(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(facts, by) if by else rows.crossJoin(F.broadcast(facts))  # without images apart, one row


def peaks(z: DataFrame, by: list[str], bands: list[str] = tuple(BAND_SECONDS), least: float = PEAK) -> DataFrame:
    """``band``, ``peak`` (its own number), ``row``, ``col``, sub-pixel ``r`` and ``c`` and strength of every peak.

    A peak is a pixel over ``least`` whose magnitude none of the 5 x 5 around it exceeds (of equal ones all are
    peaks); its place is the mean of the 3 x 3 around it, weighed by magnitude. Only pixels
    above ``least`` are compared with each other, as no other exceeds one of these.
    """
    rows = z.select(*by, "row", "col", *[F.abs(f"z_{b}").alias(b) for b in bands])
    strong = cut(rows.where(F.greatest(*[F.col(b) for b in bands]) > least))
    highest = _around(strong, by, "row", "col", 2).groupBy(*by, "row", "col").agg(*[F.max(b).alias(f"_t_{b}") for b in bands])
    top = strong.join(highest, [*by, "row", "col"])
    hit = F.filter(F.array(*[F.when((F.col(b) == F.col(f"_t_{b}")) & (F.col(b) > least), F.struct(F.lit(b).alias("band"), F.col(b).alias("strength"))) for b in bands]), lambda x: x.isNotNull())
    found = cut(top.select(*by, "row", "col", F.explode(hit).alias("x")).select(*by, "x.band", "row", "col", "x.strength"))
    near = _around(found, by, "row", "col", 1).join(rows, [*by, "row", "col"])
    magnitude = F.coalesce(*[F.when(F.col("band") == b, F.col(b)) for b in bands])
    place = near.groupBy(*by, "band", "_row", "_col", "strength").agg(*[(F.sum(magnitude * F.col(x)) / F.sum(magnitude)).alias(y) for x, y in (("row", "r"), ("col", "c"))])
    return place.select(*by, "band", F.concat_ws("/", "_row", "_col").alias("peak"), F.col("_row").alias("row"), F.col("_col").alias("col"), "r", "c", "strength")


def _around(rows: DataFrame, by: list[str], row: str, col: str, reach: int) -> DataFrame:
    """Every row once for each cell within ``reach`` of its own (``_row``, ``_col``), the cell as ``row`` and ``col``.

    Joins must not judge it by the size of ``rows``, which it multiplies, and broadcast it.
    """
    steps = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    own = rows.withColumns({"_row": F.col(row), "_col": F.col(col)}).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return own.withColumns({"row": F.col("_row") + F.col("_i"), "col": F.col("_col") + F.col("_j")}).drop("_i", "_j").hint("merge")


def lined_up(found: DataFrame, by: list[str], res: float) -> DataFrame:
    """Pairs of a first- and a last-band peak an aircraft's way apart, with the nearest peaks where it must be in between.

    Columns ``by``, ``first``, ``last`` (peaks), ``strength``, ``dr``, ``dc``, ``fit_rms_px`` and ``r_<band>``, ``c_<band>``. The pair join is
    keyed by cells of the outer radius; both bands between come from one more join and one grouping.
    """
    bands = sorted(BAND_SECONDS, key=BAND_SECONDS.get)
    first, *between, last = bands
    seconds = BAND_SECONDS[last]
    of = lambda b: found.where(F.col("band") == b).drop("band")
    apart = range_join(of(first), of(last), by, "c", "r", MOST_SPEED * seconds / res, F.col("distance") >= LEAST_SPEED * seconds / res)
    dr, dc = F.col("r_r") - F.col("l_r"), F.col("r_c") - F.col("l_c")
    pairs = cut(apart.select(*[F.col(f"l_{c}").alias(c) for c in by], F.col("l_peak").alias("first"), F.col("r_peak").alias("last"), F.col("l_strength").alias("strength"), F.col("l_r").alias(f"r_{first}"), F.col("l_c").alias(f"c_{first}"), F.col("r_r").alias(f"r_{last}"), F.col("r_c").alias(f"c_{last}"), dr.alias("dr"), dc.alias("dc")))
    share = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(BAND_SECONDS[b] / seconds).alias("share")) for b in between])
    told = pairs.withColumn("x", F.explode(share)).select(*by, "first", "last", "x.band", (F.col(f"r_{first}") + F.col("x.share") * F.col("dr")).alias("r"), (F.col(f"c_{first}") + F.col("x.share") * F.col("dc")).alias("c"))
    met = range_join(told, found.where(F.col("band").isin(between)), [*by, "band"], "c", "r", FIT_PX)
    keys = [F.col(f"l_{c}").alias(c) for c in (*by, "first", "last")]
    nearest = lambda b: F.min(F.when(F.col("l_band") == b, F.struct("distance", F.col("r_r").alias("r"), F.col("r_c").alias("c"), "r_peak")))
    between_at = met.groupBy(*keys).agg(*[nearest(b).alias(f"_{b}") for b in between]).where(F.least(*[F.col(f"_{b}").isNotNull() for b in between]))
    rms = sum((F.pow(F.col(f"_{b}.distance"), 2) for b in between), F.lit(0.0)) / len(between)
    whole = pairs.join(between_at, [*by, "first", "last"])
    return whole.withColumn("fit_rms_px", F.sqrt(rms)).withColumns({f"{x}_{b}": F.col(f"_{b}.{x}") for b in between for x in "rc"}).drop(*[f"_{b}" for b in between])


def moving(pairs: DataFrame, z: DataFrame, by: list[str]) -> DataFrame:
    """The pairs that show in each band at that band's place and in no other band there, with their ``leak``.

    A sample is the value of largest magnitude in the 3 x 3 around a real-valued place; all bands at all
    places come from one join. Magnitudes must be near the strength of a peak, alike, and of one
    sign; bands whose places overlap cannot be judged against each other.
    """
    bands = list(BAND_SECONDS)
    places = F.array(*[F.struct(F.lit(b).alias("at"), F.bround(f"r_{b}").cast("long").alias("row"), F.bround(f"c_{b}").cast("long").alias("col")) for b in bands])
    asked = pairs.select(*by, "first", "last", F.explode(places).alias("p")).select(*by, "first", "last", "p.at", F.col("p.row").alias("_pr"), F.col("p.col").alias("_pc"))
    cells = _around(asked, by, "_pr", "_pc", 1).join(z, [*by, "row", "col"])
    # Of equal magnitudes the first in reading order counts.
    strongest = lambda b: F.max_by(f"z_{b}", F.struct(F.abs(f"z_{b}"), -F.col("row"), -F.col("col")))
    seen = cells.groupBy(*by, "first", "last", "at").agg(*[strongest(b).alias(b) for b in bands])
    sample = lambda at, b: F.coalesce(F.max(F.when(F.col("at") == at, F.col(b))), F.lit(0.0)).alias(f"s_{at}_{b}")
    wide = pairs.join(seen.groupBy(*by, "first", "last").agg(*[sample(a, b) for a in bands for b in bands]), [*by, "first", "last"])
    own = [F.col(f"s_{b}_{b}") for b in bands]
    sizes = [F.abs(v) for v in own]
    alike = (F.least(*sizes) >= PEAK * 0.8) & (F.greatest(*sizes) <= MOST_RATIO * F.least(*sizes))
    one_sign = F.abs(sum((F.signum(v) for v in own), F.lit(0.0))) == len(own)
    leaks = [F.lit(0.0)]
    for a, b in APART:
        clear = F.hypot(F.col(f"r_{a}") - F.col(f"r_{b}"), F.col(f"c_{a}") - F.col(f"c_{b}")) >= OVERLAP_PX
        leaks += [F.when(clear, F.try_divide(F.abs(F.col(f"s_{x}_{y}")), F.abs(F.col(f"s_{x}_{x}")))) for x, y in ((a, b), (b, a))]
    judged = wide.withColumn("leak", F.greatest(*leaks)).where(alike & one_sign & (F.col("leak") <= MOST_LEAK))
    return judged.drop(*[f"s_{a}_{b}" for a in bands for b in bands])


def one_to_one(found: DataFrame, by: list[str]) -> DataFrame:
    """Best fits first (then the stronger), each first place (to a pixel) and each last peak once."""
    place = F.concat_ws("/", F.bround("r_blue").cast("long"), F.bround("c_blue").cast("long"))
    order = [F.col("fit_rms_px"), -F.col("strength"), F.col("first"), F.col("last")]
    return greedy_matching(found.withColumn("_place", place), by, "_place", "last", order).drop("_place")


def fuselages(found: DataFrame, pixels: DataFrame, by: list[str], band: str = "nir") -> DataFrame:
    """``by``, ``first``, ``last`` and ``axis_deg`` (0 to 180 from north) of those that are clearly resolved and clearly long.

    In the 11 x 11 around the foretold place: the part connected to the centre of what stands out by more than half the most, if it
    has eight pixels and its variances are as nine to one.
    """
    share = BAND_SECONDS[band] / BAND_SECONDS["red"]
    row, col = F.bround(F.col("r_blue") + F.col("dr") * share).cast("long"), F.bround(F.col("c_blue") + F.col("dc") * share).cast("long")
    keys = [*by, "first", "last"]
    value = F.coalesce(F.when(~F.isnan(F.col(band).cast("double")), F.col(band).cast("double")), F.lit(0.0))
    window = cut(_around(found.select(*keys, row.alias("_pr"), col.alias("_pc")), by, "_pr", "_pc", AXIS_REACH).join(pixels.select(*by, "row", "col", value.alias("v")), [*by, "row", "col"]))
    level = window.groupBy(*keys).agg(F.median("v").alias("_m"))
    raised = window.join(level, keys).withColumn("v", F.abs(F.col("v") - F.col("_m")))
    most = raised.groupBy(*keys).agg(F.max("v").alias("_top"))
    mask = cut(raised.join(most, keys).where(F.col("v") > F.col("_top") * 0.5))
    labels = regions(mask.select(*keys, "row", "col"), keys)
    centre = labels.join(mask.where("row = _row and col = _col").select(*keys, "row", "col"), [*keys, "row", "col"]).select(*keys, "label")
    x, y = F.col("col").cast("double"), -F.col("row").cast("double")
    m = labels.join(centre, [*keys, "label"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"), F.covar_samp(x, y).alias("xy"))
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.col("xy") * F.col("xy"))
    long = (F.col("n") >= AXIS_PX) & (half - root > 0) & (half + root >= AXIS_RATIO * (half - root))
    return m.where(long).select(*keys, F.pmod(F.degrees(F.lit(0.5) * F.atan2(F.col("xy") * 2, F.col("yy") - F.col("xx"))), F.lit(180.0)).alias("axis_deg"))


def _note(solved: Column, axis: Column, east: Column, north: Column, track: Column) -> Column:
    t_e, t_n = F.sin(F.radians(track)) * (CRUISE_M * SHIFT_PER_M), F.cos(F.radians(track)) * (CRUISE_M * SHIFT_PER_M)
    low, high = F.hypot(east, north), F.hypot(east + t_e, north + t_n)
    text = F.format_string("heading not measurable; true speed %.0f-%.0f m/s for 0-11 km altitude", F.least(low, high), F.greatest(low, high))
    wild = (solved["altitude_m"] > MOST_HEIGHT_M) | (solved["speed_ms"] > MOST_TRUE_SPEED)
    return (
        F.when(axis.isNull(), text)
        .when(solved.isNull(), "heading nearly parallel to the satellite track: speed/altitude not separable")
        .when(wild, "solution implausible (noisy heading); trust the apparent velocity only")
        .otherwise("")
    )


def airborne(pixels: DataFrame, by: list[str], height: int, width: int, res: float, track_deg: float = 193.0) -> DataFrame:
    """Aircraft in flight of all images: place (``row``, ``col``, half way), apparent and, where it can be told, true motion.

    ``pixels`` has ``by``, ``row``, ``col`` and the bands of ``BAND_SECONDS`` as reflectances; ``track_deg`` is where the satellite
    heads. Images share a size and a resolution. An image with fewer than a fifth of its pixels
    known in all bands gives nothing, as does an empty table.
    """
    z = strengths(pixels, by, height, width, near=PEAK)
    whole = F.lit(True)
    for b in BAND_SECONDS:
        whole = whole & F.coalesce(~F.isnan(F.col(b).cast("double")), F.lit(False))
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    enough = pixels.where(whole & inside).groupBy(*by).count().where(F.col("count") >= 0.2 * height * width)
    z = cut(z.join(enough.select(*by), by, "left_semi") if by else z.where(F.lit(enough.count() > 0)))
    tops = cut(peaks(z, by))
    found = cut(one_to_one(cut(moving(lined_up(tops, by, res), z, by)), by))
    seconds = BAND_SECONDS["red"]
    east, north = F.col("dc") * (res / seconds), -F.col("dr") * (res / seconds)
    rows = found.join(fuselages(found, pixels, by), [*by, "first", "last"], "left").withColumns({"_e": east, "_n": north})
    solved = F.when(F.col("axis_deg").isNotNull(), parallax(F.col("_e"), F.col("_n"), F.col("axis_deg"), F.lit(track_deg), SHIFT_PER_M))
    rows = rows.withColumn("_s", solved)
    sure = ~((F.col("_s.altitude_m") > MOST_HEIGHT_M) | (F.col("_s.speed_ms") > MOST_TRUE_SPEED))
    return rows.select(
        *by, (F.col("r_blue") + F.col("dr") / 2).alias("row"), (F.col("c_blue") + F.col("dc") / 2).alias("col"),
        F.hypot("_e", "_n").alias("apparent_speed_ms"), F.pmod(F.degrees(F.atan2("_e", "_n")), F.lit(360.0)).alias("apparent_heading_deg"),
        F.col("strength").alias("contrast"), F.lit(len(BAND_SECONDS)).alias("bands_matched"), "fit_rms_px", "axis_deg",
        F.when(sure, F.col("_s.speed_ms")).alias("speed_ms"), F.col("_s.heading_deg").alias("heading_deg"), F.when(sure, F.col("_s.altitude_m")).alias("altitude_m"),
        _note(F.col("_s"), F.col("axis_deg"), F.col("_e"), F.col("_n"), F.lit(track_deg)).alias("note"),
    )
