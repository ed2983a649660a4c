"""Necks of the outlines of an Arrow batch: chords between bends, for all outlines at once."""

from __future__ import annotations

import copy
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from leafmill.functions import ringarrays as ra
from leafmill.functions.maskarrays import spread

#: Outlines whose chords are looked at together.
OUTLINES = 2000


def _picked(r: ra.Rings, start: np.ndarray, size: np.ndarray) -> ra.Rings:
    """Rings from other places and of other sizes, of the same points."""
    out = copy.copy(r)
    out.start, out.size, out.whole = start, size, np.ones(len(start), bool)
    return out


def _twice(r: ra.Rings) -> ra.Rings:
    """The same rings, each followed by itself, so that what goes over its end lies together."""
    group, k = spread(2 * r.size)
    out = copy.copy(r)
    at = r.start[group] + k % r.size[group]
    out.x, out.y, out.start = r.x[at], r.y[at], 2 * (np.cumsum(r.size) - r.size)
    return out


def _extremes(v: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest of the values of groups that lie one after another; 0 of empty ones."""
    least, most, some = np.zeros(len(size)), np.zeros(len(size)), size > 0
    if some.any():
        first = (np.cumsum(size) - size)[some]
        least[some], most[some] = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
    return least, most


class Least(NamedTuple):
    """What an outline needs to be cut, in area, points and lines; and a lobe, in area and share of it."""

    area: float
    points: int
    lines: int
    lobe_area: float
    lobe_share: float


def cuts(rings: pa.Array, lines: pa.Array, where: np.ndarray, deep: float, most: int, least: Least, widest: float, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each outline the places i < j of the ends of its neck (-1 without one) and whether the lobe from i
    to j comes first; and of each line, outline by outline, whether it goes to the second lobe.

    See ``lobes.cut_at_neck``."""
    found = [_cuts(rings.slice(at, OUTLINES), lines.slice(at, OUTLINES), where[at : at + OUTLINES], deep, most, least, widest, reach) for at in range(0, len(rings), OUTLINES)]
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64),) * 4


def _cuts(rings, lines, where, deep, most, least, widest, reach):
    r = ra.Rings(rings)
    n_lines = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first_line, flat = np.cumsum(n_lines) - n_lines, lines.flatten()
    seq, x0, y0, x1, y1 = (flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("seq", "x0", "y0", "x1", "y1"))
    unknown = np.bincount(np.repeat(np.arange(len(r)), n_lines)[~np.isfinite(x0 + y0 + x1 + y1)], minlength=len(r)) > 0
    r.whole &= where & ~unknown & (r.size >= least.points) & (n_lines >= least.lines)  # others are not looked at
    area = np.abs(ra.areas2(r)) / 2
    big = r.whole & (area >= least.area)
    ring, depth, place = ra.bends(r)
    kept = big[ring] & (depth >= deep)
    ring, depth, place = ring[kept], depth[kept], place[kept]
    order = np.lexsort((place, -depth, ring))
    ring, place = ring[order], place[order]
    n = np.bincount(ring, minlength=len(r))
    k = np.arange(len(ring)) - (np.cumsum(n) - n)[ring]
    ring, place, k = ring[k < most], place[k < most], k[k < most]
    n = np.minimum(n, most)
    # each bend with those after it
    a, after = spread(n[ring] - k - 1)
    b, own, rank = a + 1 + after, ring[a], k[a] * most + after
    i, j = np.minimum(place[a], place[b]), np.maximum(place[a], place[b])
    low_x, high_x = _extremes(r.x[spread_from(r.start, r.size)], r.size)
    low_y, high_y = _extremes(r.y[spread_from(r.start, r.size)], r.size)
    width, height = high_x - low_x, high_y - low_y
    small = np.minimum(width, height)
    cx, cy = np.floor((x0 + x1) / 2), np.floor((y0 + y1) / 2)
    (ax, bx), (ay, by) = _extremes(cx, n_lines), _extremes(cy, n_lines)
    stacked = (by - ay) >= (bx - ax) * 0.8
    (px, py), (qx, qy) = r.point(own, i), r.point(own, j)
    length = np.sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))
    tilt = np.where(stacked[own], np.abs(py - qy) <= np.maximum(55.0, height[own] * 0.35), np.abs(px - qx) <= np.maximum(55.0, width[own] * 0.35))
    fits = np.flatnonzero((length >= np.maximum(4.0, np.minimum(12.0, small[own] * 0.15))) & (length < small[own] * widest) & tilt)
    double, enough = _twice(r), np.maximum(least.lobe_area, area * least.lobe_share)
    for start, size in ((i, j - i + 1), (j, r.size[own] - j + i + 1)):
        lobes = _picked(double, double.start[own[fits]] + start[fits], size[fits])
        fits = fits[np.abs(ra.areas2(lobes)) / 2 >= enough[own[fits]]]
    inside = ra.signed_squares(_picked(r, r.start[own[fits]], r.size[own[fits]]), np.floor((px + qx) / 2)[fits], np.floor((py + qy) / 2)[fits]) >= 0
    fits = fits[inside]
    # points along the chord, each with the cores of all lines
    points = np.maximum(10, np.floor(length[fits] / 4).astype(np.int64))
    pair, step = spread(points)
    of = fits[pair]
    sx, sy = (p[of] + (q[of] - p[of]) * step / (points[pair] - 1) for p, q in ((px, qx), (py, qy)))
    at, line = spread(n_lines[own[of]])
    line = first_line[own[of[at]]] + line
    half = np.maximum(3.0, np.maximum(1, y1 - y0) * 0.25)
    met = (sx[at] >= (x0 + 4)[line]) & (sx[at] <= (x1 - 4)[line]) & (sy[at] >= (cy - half)[line]) & (sy[at] <= (cy + half)[line])
    fits = fits[np.bincount(pair[at[met]], minlength=len(fits)) == 0]
    fits = fits[np.lexsort((j[fits], i[fits], rank[fits], length[fits], own[fits]))]
    fits = fits[np.append(True, np.diff(own[fits]) != 0)[: len(fits)]]
    i, j, own = i[fits], j[fits], own[fits]
    n = r.size[own]
    sides = [(double.start[own] + i, j - i + 1), (double.start[own] + j, n - j + i + 1)]
    corner = []
    for start, size in sides:
        at = spread_from(start, size)
        corner.append((_extremes(double.y[at], size)[0], _extremes(double.x[at], size)[0]))
    (one_y, one_x), (two_y, two_x) = corner
    ahead = (one_y < two_y) | ((one_y == two_y) & (one_x <= two_x))
    # the lines of the outlines that are cut: to the lobe they lie in or are nearest to, or else dealt in halves
    pair, k = spread(n_lines[own])
    line = first_line[own[pair]] + k
    near = [ra.signed_squares(_picked(double, np.where(on, a, b)[pair], np.where(on, m, n)[pair]), cx[line], cy[line]) for on in (ahead, ~ahead) for (a, m), (b, n) in [sides]]
    second, claim = near[0] < near[1], np.maximum(*near) >= -(reach * reach)
    both = np.logical_and(*(np.bincount(pair[claim & (second == x)], minlength=len(own)) > 0 for x in (False, True)))
    order = np.lexsort((seq[line], np.where(stacked[own[pair]], cy[line], cx[line]), pair))
    late = np.empty(len(pair), bool)
    late[order] = k >= (n_lines[own[pair]] + 1) // 2
    to = np.zeros(len(x0), np.int64)
    to[line] = np.where(both[pair], second, late)
    out = np.full((2, len(r)), -1)
    out[:, own] = i, j
    first = np.zeros(len(r), np.int64)
    first[own] = ahead
    return *out, first, to


def spread_from(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the points of all rings, one after another."""
    group, k = spread(size)
    return start[group] + k
