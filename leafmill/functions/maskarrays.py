"""Masks of an Arrow batch as arrays: the runs of all its pages at once.

The runs of a mask are maximal and lie by group (the page's number in the batch), row and start; each
step sorts or searches the runs of all groups together. What is under a row of a group never meets
what is under another: rows lie one after another on one line of whole numbers."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from leafmill.functions.clusterarrays import _joined as rooted


class Runs(NamedTuple):
    """Cells s <= x < e of a row of a group."""

    group: np.ndarray
    row: np.ndarray
    s: np.ndarray
    e: np.ndarray

    def at(self, which: np.ndarray) -> Runs:
        return Runs(*(v[which] for v in self))

    def of(self, group: np.ndarray) -> Runs:
        """The same runs under other groups."""
        return self._replace(group=group)


def both_of(*runs: Runs) -> Runs:
    """Several tables of runs as one, in no order."""
    return Runs(*(np.concatenate(v).astype(np.int64) for v in zip(*runs)))


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes one after another: the group of each member, its place in it."""
    group = np.repeat(np.arange(len(n)), n)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)


def joined(runs: Runs) -> Runs:
    """Any runs as maximal ones: those that meet or touch become one."""
    if not len(runs.s):
        return both_of(runs)
    runs = runs.at(np.lexsort((runs.s, runs.row, runs.group)))
    line = np.cumsum(np.append(0, (np.diff(runs.group) != 0) | (np.diff(runs.row) != 0)))
    base = line * (int(runs.e.max()) - int(runs.s.min()) + 2) - int(runs.s.min())
    reach = np.maximum.accumulate(base + runs.e)
    first = np.flatnonzero(np.append(True, (base + runs.s)[1:] > reach[:-1]))
    last = np.append(first[1:], len(line)) - 1
    return Runs(runs.group[first], runs.row[first], runs.s[first], reach[last] - base[last])


def boxes(group: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Runs:
    """The runs of boxes, ends excluded; overlapping ones of a group become one mask."""
    of, k = spread(np.where(x1 > x0, np.maximum(y1 - y0, 0), 0))
    return joined(Runs(group[of], y0[of] + k, x0[of], x1[of]))


def swept(a: Runs, b: Runs) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Both masks as pieces that lie wholly in or out of each, and which are in a and in b.

    Runs open at their start and close at their end, so nothing is open past the end of a row."""
    ends = both_of(a, a, b, b)
    x = np.concatenate([a.s, a.e, b.s, b.e]).astype(np.int64)
    step = np.repeat([1, -1, 1, -1], [len(a.s), len(a.s), len(b.s), len(b.s)])
    mine = np.arange(len(x)) < 2 * len(a.s)
    order = np.lexsort((x, ends.row, ends.group))
    x, step, mine = x[order], step[order], mine[order]
    ina, inb = np.cumsum(np.where(mine, step, 0)) > 0, np.cumsum(np.where(mine, 0, step)) > 0
    some = np.flatnonzero((ina | inb)[:-1] & (x[1:] > x[:-1]))
    return Runs(ends.group[order][some], ends.row[order][some], x[some], x[some + 1]), ina[some], inb[some]


def combined(a: Runs, b: Runs, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Runs:
    """The runs of the cells of either mask for which ``keep`` (is in a, is in b) holds."""
    pieces, ina, inb = swept(a, b)
    return joined(pieces.at(keep(ina, inb)))


def both(a: Runs, b: Runs) -> Runs:
    return combined(a, b, lambda x, y: x & y)


def without(a: Runs, b: Runs) -> Runs:
    return combined(a, b, lambda x, y: x & ~y)


def either(a: Runs, b: Runs) -> Runs:
    return combined(a, b, lambda x, y: x | y)


def grown(runs: Runs, by: int = 1) -> Runs:
    """A mask and all cells within ``by`` steps (left, right, up or down) of it."""
    return joined(both_of(*(Runs(runs.group, runs.row + d, runs.s - by + abs(d), runs.e + by - abs(d)) for d in range(-by, by + 1))))


def meeting(a: Runs, b: Runs, down: int = 0, reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (place in a, place in b) of runs that share a cell, where b's row is ``down`` below that
    of a; with ``reach`` 1 those that touch as well. ``a`` may be in any order and overlap."""
    if not len(a.s) or not len(b.s):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    top = min(int(a.row.min()) + down, int(b.row.min()))
    rows = max(int(a.row.max()) + down, int(b.row.max())) - top + 1
    left = min(int(a.s.min()), int(b.s.min())) - 2
    wide = max(int(a.e.max()), int(b.e.max())) - left + 3
    key, asked = b.group * rows + b.row - top, a.group * rows + a.row + down - top
    lines = key[np.append(True, np.diff(key) != 0)]
    line = np.minimum(np.searchsorted(lines, asked), len(lines) - 1)
    here = np.searchsorted(lines, key) * wide - left
    there = line * wide - left
    lo = np.searchsorted(here + b.e, there + a.s - reach, side="right")
    n = np.where(lines[line] == asked, np.maximum(np.searchsorted(here + b.s, there + a.e + reach) - lo, 0), 0)
    i, k = spread(n)
    return i, lo[i] + k


def parts(runs: Runs, corners: bool = True) -> np.ndarray:
    """A number for each connected part, the place of its first run; cells that meet at a corner are
    connected with ``corners``."""
    i, j = meeting(runs, runs, -1, int(corners))
    return rooted(np.arange(len(runs.s)), i, j)


class Sizes(NamedTuple):
    """Cells, runs and box of each of some groups, in their order."""

    group: np.ndarray
    cells: np.ndarray
    runs: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray


def sizes(runs: Runs) -> Sizes:
    if not len(runs.s):
        return Sizes(*[np.empty(0, np.int64)] * 7)
    r = runs.at(np.argsort(runs.group, kind="stable"))
    first = np.flatnonzero(np.append(True, np.diff(r.group) != 0))
    least, most = (lambda v: np.minimum.reduceat(v, first)), (lambda v: np.maximum.reduceat(v, first))
    return Sizes(r.group[first], np.add.reduceat(r.e - r.s, first), np.diff(np.append(first, len(r.s))), least(r.s), least(r.row), most(r.e), most(r.row) + 1)


def widest(runs: Runs) -> dict:
    """The first row of each group and its rows' widest runs (the leftmost of equals) as a list of (s, e)."""
    r = runs.at(np.lexsort((runs.s, runs.s - runs.e, runs.row, runs.group)))
    r = r.at(np.append(True, (np.diff(r.group) != 0) | (np.diff(r.row) != 0))[: len(r.s)])
    first = np.flatnonzero(np.append(True, np.diff(r.group) != 0)[: len(r.s)])
    spans = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (r.s, r.e)], ["s", "e"])
    offsets = pa.array(np.append(first, len(r.s)).astype(np.int32))
    return {"group": r.group[first], "top": r.row[first].astype(np.int32), "spans": pa.ListArray.from_arrays(offsets, spans)}


def points(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> Runs:
    return Runs(group, y, x, x + 1)


def reached(field: Runs, seeds: Runs) -> Runs:
    """The connected parts (4 neighbours) of ``field`` that hold a seed."""
    part = parts(field, corners=False)
    _, hit = meeting(seeds, field)
    return field.at(np.isin(part, part[hit]))


def holes(runs: Runs, most: int) -> Runs:
    """The runs of what a mask encloses, for holes of under ``most`` cells."""
    m = sizes(runs)
    outside = without(boxes(m.group, m.x0 - 1, m.y0 - 1, m.x1 + 1, m.y1 + 1), runs)
    part = parts(outside, corners=False)
    h = sizes(outside.of(part))
    of = np.searchsorted(m.group, outside.group[h.group])
    within = (h.x0 >= m.x0[of]) & (h.y0 >= m.y0[of]) & (h.x1 <= m.x1[of]) & (h.y1 <= m.y1[of])
    return outside.at(np.isin(part, h.group[within & (h.cells < most)]))


def grow_selection(mask: Runs, field: Runs, barrier: Runs, seeds: Runs, most: int, near: int = 5) -> Runs:
    """``masks.grow_selection`` for all groups at once."""
    new = without(reached(without(field, barrier), seeds), mask)
    part = parts(new)
    i, _ = meeting(new, grown(mask, near))
    merged = either(mask, new.at(np.isin(part, part[i])))
    return either(merged, without(holes(merged, most), barrier))


def scissors(mask: Runs, stroke: Runs, lines: Runs, dust: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``masks.scissors`` for all groups at once: the groups that have a mask, their cells, how many parts
    each has, and the side of each of ``lines`` (1, 2, or 0 where it is in both or neither)."""
    whole = sizes(mask)
    cut = without(mask, stroke)
    part = parts(cut)
    p = sizes(cut.of(part))
    owner = np.searchsorted(whole.group, cut.group[p.group])
    large = p.cells >= np.maximum(dust, np.floor(whole.cells[owner] * share))
    n = np.bincount(owner[large], minlength=len(whole.group))
    halves = np.flatnonzero(large & (n[owner] == 2) & (whole.cells[owner] >= 50))
    halves = halves[np.lexsort((p.group[halves], p.x0[halves], p.y0[halves] // 40, owner[halves]))]
    side = np.zeros(len(cut.s) + 1, np.int64)
    side[p.group[halves]] = 1 + np.arange(len(halves)) % 2
    side = side[part]
    found = np.zeros((2, len(lines.s)), bool)
    for k in (1, 2):
        back = both(grown(cut.at(side == k)), mask)
        found[k - 1, meeting(lines, back)[0]] = True
    return whole.group, whole.cells, n, np.where(found[0] == found[1], 0, np.where(found[0], 1, 2))
