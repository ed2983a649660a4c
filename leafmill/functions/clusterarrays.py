"""Clusters of lines as arrays: the lines of all pages or clusters of an Arrow batch at once.

``group`` numbers the page or cluster of each line from 0. Coordinates are doubles, NaN where null;
what compares them does as SQL does (a comparison with null doesn't hold, extremes leave nulls out)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs of lines that are looked at together.
PAIRS = 1 << 20
#: Keys of a group are this far apart; coordinates are 32-bit integers.
FAR = 1 << 34


def numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _key(group: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole numbers that order values within their groups; nulls come first."""
    return group * FAR + np.where(np.isnan(v), -(FAR >> 2), np.clip(v, 1 - (FAR >> 2), FAR >> 2)).astype(np.int64) + (FAR >> 1)


def numbered(group: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the parts of groups."""
    order = np.lexsort((part, group))
    new = (group[order][1:] != group[order][:-1]) | (part[order][1:] != part[order][:-1])
    out = np.empty(len(group), np.int64)
    out[order] = np.cumsum(np.append(0, new))
    return out


def _extreme(best: np.ufunc, group: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """The largest or smallest (``fmax``, ``fmin``) value of each group; NaN without one."""
    out = np.full(n, np.nan)
    best.at(out, group, v)
    return out


def column_cuts(group: np.ndarray, n: int, x0: np.ndarray, x1: np.ndarray, seq: np.ndarray, gap: int = 12, slack: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Where each group's widest free vertical strip of at least ``gap`` lies, NaN unless every line falls
    wholly on one side of it (with some slack) and both have some; and which lines lie right of it."""
    order = np.lexsort((seq, _key(group, x0)))
    g, start = group[order], x0[order]
    reach = np.maximum.accumulate(_key(g, x1[order])) - g * FAR - (FAR >> 1)
    end = np.where(reach > -(FAR >> 2), reach, np.nan)[:-1]
    free = np.where(g[1:] == g[:-1], start[1:] - end, np.nan)
    wide = free >= gap
    own, free, end = g[:-1][wide], free[wide], end[wide]
    first = free == _extreme(np.fmax, own, n, free)[own]
    end_at = _extreme(np.fmin, own[first], n, end[first])
    at = np.floor((2 * end_at + _extreme(np.fmax, own, n, free)) / 2)
    left, right = x1 <= at[group] + slack, x0 >= at[group] - slack
    n_left, n_right, size = (np.bincount(x, minlength=n) for x in (group[left], group[right], group))
    clean = (n_left + n_right == size) & (n_left > 0) & (n_right > 0)
    return np.where(clean, at, np.nan), right & clean[group]


def stacked_cuts(group: np.ndarray, n: int, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many lines of each group of four or more lie above its break, NaN without one; and which lines lie below.

    In a tall narrow group the first gap of 25 below the second line counts, else the largest of at least 28."""
    order = np.lexsort((seq, _key(group, y0)))
    g, size = group[order], np.bincount(group, minlength=n)
    place = np.arange(len(g)) - (np.cumsum(size) - size)[g] + 1
    below = np.append(np.where(g[1:] == g[:-1], y0[order][1:] - y1[order][:-1], np.nan), np.nan)[: len(g)]
    h = _extreme(np.fmax, group, n, y1) - _extreme(np.fmin, group, n, y0)
    w = _extreme(np.fmax, group, n, x1) - _extreme(np.fmin, group, n, x0)
    tall = (h >= 1.1 * w) & (h >= 130)
    inner = (place >= 2) & (place < size[g])
    broken = inner & tall[g] & (below >= 25)
    at = _extreme(np.fmin, g[broken], n, place[broken].astype(float))
    wide = inner & (below >= 28)
    largest = wide & (below == _extreme(np.fmax, g[wide], n, below[wide])[g])
    at = np.where(np.isnan(at), _extreme(np.fmin, g[largest], n, place[largest].astype(float)), at)
    at = np.where(size >= 4, at, np.nan)
    lower = np.zeros(len(g), bool)
    lower[order] = place > at[g]
    return at, lower


def components(group: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, seq: np.ndarray, max_dx: int, max_dy: int, tolerance: float) -> np.ndarray:
    """The smallest seq that each line reaches by the pairs of its page (those of ``lines.line_pairs``).

    Down a page, a line meets those that start above its lower end and ``max_dy``; pairs are taken in blocks."""
    order = np.flatnonzero(~np.isnan(y0) & ~np.isnan(y1))
    order = order[np.argsort(_key(group[order], y0[order]), kind="stable")]
    g = group[order]
    until = np.searchsorted(_key(g, y0[order]), _key(g, y1[order] + max_dy), side="right")
    many = np.maximum(until - np.arange(len(order)) - 1, 0)
    upto = np.cumsum(many)
    root = np.arange(len(group))
    at = 0
    while at < len(order):
        before = upto[at] - many[at]
        stop = max(at + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        here = many[at:stop]
        first = np.repeat(np.arange(at, stop), here)
        second = first + 1 + np.arange(len(first)) - np.repeat(upto[at:stop] - here - before, here)
        a, b = order[first], order[second]
        gap_x = np.fmax(0, np.fmax(x0[a], x0[b]) - np.fmin(x1[a], x1[b]))
        gap_y = np.fmax(0, np.fmax(y0[a], y0[b]) - np.fmin(y1[a], y1[b]))
        apart = np.abs(x0[a] + x1[a] - x0[b] - x1[b])
        centred = apart <= np.fmax(np.fmax(x1[a] - x0[a], x1[b] - x0[b]) * tolerance, 2.0 * max_dx)
        near = (gap_x <= min(max_dx, 12)) & ~((gap_x > 15) & (gap_y > 15))
        kept = (gap_y <= max_dy) & (centred | near)
        root = _joined(root, a[kept], b[kept])
        at = stop
    least = np.full(len(group), np.iinfo(np.int64).max)
    np.minimum.at(least, root, seq)
    return least[root]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of lines (each its own, or the root of a smaller place) after joining all pairs."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
