"""The best ship of every sighting of a crowded bucket, without weighing every ship.

A ship's reports are cut into spells in which its place is linear in time. For some sightings at a time the spells are put into
blocks of like distance in time, length and place; what a block holds at most is known from its bounds, so only blocks
that can hold the best ship, or one as good, are weighed. The sum of all weights is needed only where the best could still
outweigh the others; elsewhere the weights met so far already decide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from orbweave.functions import geo

#: Spells of a block, sightings and seconds that are looked at together, pairs that are weighed at once.
BLOCK, ROWS, SPAN_S, AT_ONCE = 32, 256, 120, 1 << 14
#: Blocks that look best and are weighed first.
_FIRST = 2
#: Cuts of each class of distance in time by length and by longitude, so that a block has about as many.
_CLASSES = 6
#: Bounds are compared with this much to spare.
_SPARE = 1e-9


def spells(right: Callable[[str], np.ndarray], window_s: int, knots: float) -> dict[str, np.ndarray]:
    """Spells of all ships from reports sorted by ship, time and place: from one report to the next, or by one report alone.

    ``rank`` tells ships apart (one that tells several lengths is several), in their order. At ``t`` from ``begin`` to
    ``end`` the place is ``lat + num * by_lat / per_lat`` with ``num = (t - start) * rate / gap``, and so for lon.
    """
    code, t, length = right("_code"), right("t"), right("length_m")
    run = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (t[1:] != t[:-1])))
    length = np.fmax.reduceat(length, run)
    code, t, key = code[run], t[run], np.where(np.isnan(length), -np.inf, length)
    order = np.lexsort((t, key, code))
    run, code, t, key, length = run[order], code[order], t[order], key[order], length[order]
    lat, lon, sog, cog = (right(c)[run] for c in ("lat", "lon", "sog", "cog"))
    new = np.append(True, (code[1:] != code[:-1]) | (key[1:] != key[:-1]))
    rank, n = np.cumsum(new) - 1, len(run)
    follows = np.append(~new[1:], False)
    after = np.where(follows, np.append(t[1:], 0), np.iinfo(np.int64).max // 4)  # of each report the next one of its ship
    before = np.where(new, np.iinfo(np.int64).min // 4, np.append(0, t[:-1]))
    k = np.arange(n)
    both = k[follows]
    a, b = np.concatenate([both, k, k]), np.concatenate([both + 1, k, k])
    linear = np.arange(len(a)) < len(both)
    begin = np.concatenate([np.maximum(t[both], t[both + 1] - window_s), t, np.maximum(t - window_s, before + window_s + 1)])
    end = np.concatenate([np.minimum(t[both + 1] - 1, t[both] + window_s), np.minimum(t + window_s, after - window_s - 1), t - 1])
    with np.errstate(invalid="ignore"):
        goes = (np.nan_to_num(sog) != 0) & ~np.isnan(cog) & (sog < 60)
    speed = np.where(goes, sog * knots, 0.0)
    course = np.radians(np.where(goes, cog, 0.0))
    made = {
        "rank": rank[a], "row": run[a], "begin": begin, "end": end, "linear": linear, "start": t[a], "next": t[b], "lat": lat[a], "lon": lon[a], "length": length[a],
        "rate": np.where(linear, 1.0, speed[a]), "gap": np.where(linear, t[b] - t[a], 1).astype(float),
        "by_lat": np.where(linear, lat[b] - lat[a], np.cos(course[a])), "by_lon": np.where(linear, lon[b] - lon[a], np.sin(course[a])),
        "per_lat": np.where(linear, 1.0, geo.M_PER_LAT),
    }
    lasts = made["begin"] <= made["end"]
    return {c: v[lasts] for c, v in made.items()}


#: What a place is worked out from.
_PLACE = ("linear", "start", "next", "lat", "lon", "rate", "gap", "by_lat", "by_lon", "per_lat")


def place(s: dict[str, np.ndarray], t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lat, lon and uncertainty of spells at their times."""
    gone = t - s["start"]
    num = gone * s["rate"] / s["gap"]
    lat = s["lat"] + num * s["by_lat"] / s["per_lat"]
    lon = s["lon"] + num * s["by_lon"] / np.where(s["linear"], 1.0, geo.M_PER_LON * np.cos(np.radians(lat)))
    return lat, lon, np.where(s["linear"], 50.0 + 0.5 * np.minimum(gone, s["next"] - t), 100.0 + np.abs(gone) * 2)


def weights(own: dict[str, np.ndarray], ship: np.ndarray, lat: np.ndarray, lon: np.ndarray, uncertainty: np.ndarray, least_sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance and weight of sightings (lat, lon, length) and ships at their places."""
    with np.errstate(all="ignore"):
        d = np.hypot((lon - own["lon"]) * geo.M_PER_LON * np.cos(np.radians(own["lat"])), (lat - own["lat"]) * geo.M_PER_LAT)
        sigma = np.hypot(uncertainty, least_sigma)
        known = (np.nan_to_num(ship) != 0) & (np.nan_to_num(own["length"]) != 0)
        by_length = np.exp(-0.5 * ((ship - own["length"]) / np.fmax(25.0, 0.2 * ship)) ** 2)
        return d, np.exp(-0.5 * (d / sigma) ** 2) * np.where(known, by_length, 1.0)


def _blocks(s: dict[str, np.ndarray], t0: int, t1: int, least_sigma: float) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Spells with a row for each block, and the bounds of every block from ``t0`` to ``t1``."""
    ends = [place(s, np.clip(t, s["begin"], s["end"])) for t in (t0, (t0 + t1) // 2, t1)]
    lat, lon, unc = ends[1]
    apart = np.clip(np.log2(unc / 100.0), 0, _CLASSES - 1).astype(int)
    cuts = max(1, round((len(lat) / _CLASSES / BLOCK) ** (1 / 3)))

    def part(v: np.ndarray) -> np.ndarray:
        low, high = v.min(), v.max()
        return np.minimum(((v - low) / max(high - low, 1e-12) * cuts).astype(int), cuts - 1)

    known = np.nan_to_num(s["length"]) != 0
    length = np.where(known, s["length"], 0.0)
    order = np.lexsort((lat, part(lon), part(length), apart, known))
    first = np.arange(0, len(order), BLOCK)
    filled = np.append(order, np.full(-len(order) % BLOCK, order[-1]))
    s = {c: v[filled].reshape(-1, BLOCK) for c, v in s.items()}
    s["end"].reshape(-1)[len(order) :] = np.iinfo(np.int64).min  # what fills the last block never counts
    low = lambda values: np.minimum.reduceat(np.minimum.reduce([v[order] for v in values]), first)
    high = lambda values: np.maximum.reduceat(np.maximum.reduce([v[order] for v in values]), first)
    lats, lons, uncs = zip(*ends, strict=True)
    most = high(uncs)
    most = np.hypot(most + (t1 - t0), least_sigma)  # between the ends it may rise by half a metre a second, or two
    top = high([length])
    return s, {
        "lat0": low(lats), "lat1": high(lats), "lon0": low(lons), "lon1": high(lons), "sigma": most,
        "len0": np.where(low([known]), low([length]), -np.inf), "len1": np.where(low([known]), top, np.inf), "spread": np.fmax(25.0, 0.2 * top),
    }


def _least(own: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Of every sighting and block a bound z: no ship of the block has more than exp(-z / 2)."""
    off = lambda v, low, high: np.maximum(np.maximum(b[low] - v, v - b[high]), 0.0)
    y = off(own["lat"][:, None], "lat0", "lat1") * geo.M_PER_LAT
    x = off(own["lon"][:, None], "lon0", "lon1") * (geo.M_PER_LON * np.cos(np.radians(own["lat"])))[:, None]
    length = own["length"][:, None]
    known = np.nan_to_num(length) != 0
    with np.errstate(invalid="ignore"):
        l = np.where(known, off(np.where(known, length, 0.0), "len0", "len1"), 0.0) / b["spread"]
    return ((x * x + y * y) / (b["sigma"] * b["sigma"]) + l * l) * (1 - _SPARE)


def _middling(own: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Of every sighting and block about the bound's mean over the block: where it is low a good ship is likely."""
    def off(v: np.ndarray, low: str, high: str) -> np.ndarray:
        return (v - (b[low] + b[high]) / 2) ** 2 + (b[high] - b[low]) ** 2 / 12

    y = off(own["lat"][:, None], "lat0", "lat1") * geo.M_PER_LAT**2
    x = off(own["lon"][:, None], "lon0", "lon1") * (geo.M_PER_LON * np.cos(np.radians(own["lat"])))[:, None] ** 2
    with np.errstate(invalid="ignore"):
        l = np.nan_to_num(off(own["length"][:, None], "len0", "len1"), nan=0.0, posinf=0.0) / b["spread"] ** 2
    return (x + y) / b["sigma"] ** 2 + l


class _Best:
    """Best weight, its distance and spell, and the sum of the weights met so far, of every sighting."""

    def __init__(self, n: int):
        self.w, self.d, self.rank, self.row, self.sum = np.full(n, -1.0), np.full(n, np.nan), np.full(n, -1), np.full(n, -1), np.zeros(n)

    def meet(self, i: np.ndarray, own: dict[str, np.ndarray], s: dict[str, np.ndarray], block: np.ndarray, least_sigma: float) -> None:
        """Sightings ``i`` (sorted) and blocks; ships out of their spell's time count for nothing."""
        t = own["t"][i, None]
        lasts = (s["begin"][block] <= t) & (t <= s["end"][block])
        there = place({c: s[c][block] for c in _PLACE}, t)
        d, w = weights({c: own[c][i, None] for c in ("lat", "lon", "length")}, s["length"][block], *there, least_sigma)
        run = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        self.sum[i[run]] += np.add.reduceat(np.where(lasts, w, 0.0).sum(1), run)
        w = np.where(lasts, w, -1.0)
        top = w.max(1)
        rank = np.where(w == top[:, None], s["rank"][block], np.iinfo(np.int64).max)  # of equal weights the lowest ship
        at = rank.argmin(1)
        rank = rank[np.arange(len(i)), at]
        order = np.lexsort((rank, -top, i))
        k = order[run]  # the best of each sighting's blocks
        k = k[top[k] >= 0]
        k = k[(top[k] > self.w[i[k]]) | ((top[k] == self.w[i[k]]) & (rank[k] < self.rank[i[k]]))]
        who, at = i[k], at[k]
        self.w[who], self.d[who], self.rank[who], self.row[who] = top[k], d[k, at], rank[k], s["row"][block[k], at]


def best(own: dict[str, np.ndarray], right: Callable[[str], np.ndarray], window_s: int, knots: float, least_sigma: float, none: float, accept: float, reach: float) -> dict[str, np.ndarray]:
    """Report row (-1: no ship), distance and probability of the best ship of every sighting; sightings (t, lat, lon, length) are sorted by ``t`` and all reports are near in place.

    The probability is the best weight's share of all weights and ``none``; it is nan where it is below ``accept`` or
    the distance not below ``reach``.
    """
    n, whole = len(own["t"]), spells(right, window_s, knots)
    row, d, p = np.full(n, -1), np.full(n, np.nan), np.full(n, np.nan)
    k = 0
    while k < n:
        k1 = min(k + ROWS, int(np.searchsorted(own["t"], own["t"][k] + SPAN_S, "right")))
        some = {c: v[k:k1] for c, v in own.items()}
        t0, t1 = int(some["t"][0]), int(some["t"][-1])
        now = (whole["begin"] <= t1) & (whole["end"] >= t0)
        if now.any():
            found, open_ = _slice(some, *_blocks({c: v[now] for c, v in whole.items()}, t0, t1, least_sigma), least_sigma, none, accept, reach)
            row[k:k1], d[k:k1] = found.row, found.d
            p[k:k1] = np.where(open_, found.w / (found.sum + none), np.nan)
        k = k1
    return {"row": row, "d": d, "p": p}


def _slice(own: dict[str, np.ndarray], s: dict[str, np.ndarray], b: dict[str, np.ndarray], least_sigma: float, none: float, accept: float, reach: float) -> tuple[_Best, np.ndarray]:
    """The best ships, and for which sightings all were weighed."""
    n, m = len(own["t"]), len(b["sigma"])
    found, bound = _Best(n), _least(own, b)
    weighed = np.zeros((n, m), dtype=bool)

    def weigh(which: np.ndarray) -> None:
        i, block = np.nonzero(which & ~weighed)
        weighed[i, block] = True
        for k in range(0, len(i), AT_ONCE // BLOCK):
            found.meet(i[k : k + AT_ONCE // BLOCK], own, s, block[k : k + AT_ONCE // BLOCK], least_sigma)

    likely = np.zeros((n, m), dtype=bool)
    likely[np.arange(n)[:, None], np.argpartition(_middling(own, b), min(_FIRST, m) - 1, 1)[:, :_FIRST]] = True
    weigh(likely)
    with np.errstate(divide="ignore", invalid="ignore"):
        within = np.where(found.w > 0, -2 * np.log(np.maximum(found.w, 1e-300)) + _SPARE, np.inf)
    within = np.where(found.w > 1e-290, within, np.inf)
    weigh(bound <= within[:, None])
    open_ = (found.w >= 0) & (found.d < reach) & (found.w * (1 + _SPARE) >= accept * (found.sum + none))
    weigh(np.broadcast_to(open_[:, None], (n, m)))
    return found, open_
