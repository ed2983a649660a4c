"""Rings of an Arrow batch as arrays: hulls, bends, corners and distances for all of them at once.

Each step works on all rings of a batch; no ring is walked over by itself. A ring with a null or
NaN in it has null results. ``leafmill.functions.polygons`` makes column builders of these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Places of rings (those of the longest, times rings) that are worked on at once.
PLACES = 1 << 20


class Rings:
    """The points of rings one after another (``x``, ``y``), with the first place and size of each."""

    def __init__(self, rings: pa.Array):
        size = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        points = rings.flatten()
        self.x, self.y = (pc.list_element(points, k).to_numpy(zero_copy_only=False) if len(points) else np.empty(0) for k in (0, 1))
        self.start, self.size = np.cumsum(size) - size, size
        self.whole = rings.is_valid().to_numpy(zero_copy_only=False).copy()
        self.whole[np.repeat(np.arange(len(size)), size)[~np.isfinite(self.x + self.y)]] = False

    def __len__(self) -> int:
        return len(self.size)

    def point(self, ring: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.start[ring] + i % self.size[ring]
        return self.x[at], self.y[at]

    def nulls(self) -> pa.Array:
        return pa.array(~self.whole)


def _blocks(r: Rings) -> Iterator[np.ndarray]:
    """The numbers of whole rings in blocks of like sizes and bounded padding."""
    order = np.flatnonzero(r.whole & (r.size > 0))
    order = order[np.argsort(r.size[order], kind="stable")]
    at = 0
    while at < len(order):
        n = max(1, PLACES // int(r.size[order[at]]))
        while n > 1 and int(r.size[order[min(at + n, len(order)) - 1]]) * n > 2 * PLACES:
            n //= 2
        yield order[at : at + n]
        at += n


def _padded(r: Rings, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of a block's rings, a row each, and where there is no point."""
    i = np.arange(int(r.size[block].max()))
    none = i >= r.size[block][:, None]
    at = np.where(none, 0, r.start[block][:, None] + i)
    return r.x[at], r.y[at], none


def _flat(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes one after another: the group of each member, its place in it."""
    group = np.repeat(np.arange(len(size)), size)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)


def areas2(r: Rings) -> np.ndarray:
    """Twice the signed areas."""
    return _sums(r, lambda ax, ay, bx, by: ax * by - bx * ay)


def perimeters(r: Rings) -> np.ndarray:
    return _sums(r, lambda ax, ay, bx, by: np.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)))


def _sums(r: Rings, of) -> np.ndarray:
    """Sums over edges, added up in the order of the ring."""
    out = np.zeros(len(r))
    for block in _blocks(r):
        n = r.size[block]
        total = np.zeros(len(block))
        for k in range(int(n.max())):
            on = k < n
            value = of(*r.point(block, np.where(on, k, 0)), *r.point(block, np.where(on, k + 1, 0)))
            total = np.where(on, total + value, total)
        out[block] = total
    return out


def _chain(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One side of each row's hull: places on a stack, and its height. Rows take a step each at once."""
    stack, top, at = np.zeros((len(x), x.shape[1] + 1), dtype=np.int64), np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    rows = np.flatnonzero(at < size)
    while len(rows):
        t, p = top[rows], at[rows]
        a, b = stack[rows, np.maximum(t - 2, 0)], stack[rows, np.maximum(t - 1, 0)]
        ox, oy = x[rows, a], y[rows, a]
        turn = (x[rows, b] - ox) * (y[rows, p] - oy) - (y[rows, b] - oy) * (x[rows, p] - ox)
        back = (t >= 2) & ~(turn > 0)
        top[rows[back]] -= 1
        on = rows[~back]
        stack[on, top[on]] = at[on]
        top[on] += 1
        at[on] += 1
        rows = rows[at[rows] < size[rows]]
    return stack, top


def hull_places(r: Rings) -> tuple[np.ndarray, np.ndarray]:
    """The rings and places of the corners of all hulls: by ring, in the order of monotone chains."""
    found = []
    for block in _blocks(r):
        x, y, none = _padded(r, block)
        size = r.size[block]
        order = np.lexsort((y, np.where(none, np.inf, x)), axis=1)  # stable: equal points by place
        rows = np.arange(len(block))[:, None]
        # the way back starts at the last point of each row
        back = order[rows, np.maximum(size[:, None] - 1 - np.arange(order.shape[1]), 0)]
        for side, way in enumerate((order, back)):
            stack, top = _chain(x[rows, way], y[rows, way], size)
            ring, k = np.nonzero(np.arange(stack.shape[1]) < top[:, None] - 1)
            found.append(np.stack([block[ring], np.full(len(ring), side), k, way[ring, stack[ring, k]]]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    ring, side, k, place = np.concatenate(found, axis=1)
    order = np.lexsort((k, side, ring))
    return ring[order], place[order]


def lists(r: Rings, ring: np.ndarray, values: pa.Array) -> pa.Array:
    """``values``, sorted by ``ring``, as one list a ring."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(ring, minlength=len(r)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=r.nulls())


def hull_areas(r: Rings) -> np.ndarray:
    ring, place = hull_places(r)
    n = np.bincount(ring, minlength=len(r))
    group, k = _flat(n)
    after = place[(np.cumsum(n) - n)[group] + (k + 1) % n[group]]
    (ax, ay), (bx, by) = r.point(ring, place), r.point(ring, after)
    return np.abs(np.bincount(ring, weights=ax * by - bx * ay, minlength=len(r))) / 2


def farthest(r: Rings, ring: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span the depth and place of the point between s and e that is farthest from their
    line, the first of equals; depth -1 without one."""
    depth, place = np.full(len(s), -1.0), np.zeros(len(s), dtype=np.int64)
    spans = np.flatnonzero(e - s > 1)
    if not len(spans):
        return depth, place
    n = (e - s - 1)[spans]
    group, k = _flat(n)
    of = spans[group]
    i = s[of] + 1 + k
    (ax, ay), (bx, by), (px, py) = r.point(ring[of], s[of]), r.point(ring[of], e[of]), r.point(ring[of], i)
    dx, dy, px, py = bx - ax, by - ay, px - ax, py - ay
    length = dx * dx + dy * dy
    line = length > 0
    off = np.where(line, np.abs(dx * py - dy * px) / np.sqrt(np.where(line, length, 1.0)), np.sqrt(px * px + py * py))
    first = np.cumsum(n) - n
    most = np.maximum.reduceat(off, first)
    hit = np.flatnonzero(off == most[group])
    _, once = np.unique(group[hit], return_index=True)
    depth[spans], place[spans] = most, i[hit[once]]
    return depth, place


def bends(r: Rings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ring, depth, place) of the deepest point under each side of the hulls that has some."""
    ring, place = hull_places(r)
    order = np.lexsort((place, ring))
    ring, place = ring[order], place[order]
    n = np.bincount(ring, minlength=len(r))
    group, k = _flat(n)
    last = k + 1 == n[group]
    after = place[(np.cumsum(n) - n)[group] + np.where(last, 0, k + 1)] + np.where(last, r.size[ring], 0)
    depth, far = farthest(r, ring, place, after)
    some = depth >= 0
    return ring[some], depth[some], (far % np.maximum(r.size[ring], 1))[some]


def kept_places(r: Rings, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ring, place) of the points that Douglas and Peucker's rule keeps, in order.

    All spans of a depth of cutting are looked at together."""
    few = np.flatnonzero(r.whole & (r.size > 0) & (r.size <= 2))
    group, k = _flat(r.size[few])
    found = [np.stack([few[group], k])]
    rings = np.flatnonzero(r.whole & (r.size > 2))
    if len(rings):
        a = _farthest_from(r, rings, np.zeros(len(rings), dtype=np.int64))
        n = r.size[rings]
        middle = a + (_farthest_from(r, rings, a) - a) % n
        ring, s, e = np.concatenate([rings, rings]), np.concatenate([a, middle]), np.concatenate([middle, a + n])
        while len(ring):
            depth, far = farthest(r, ring, s, e)
            deep = (depth >= 0) & (depth > tolerance[ring])
            found.append(np.stack([ring[~deep], s[~deep] % r.size[ring[~deep]]]))
            ring, s, e, far = ring[deep], s[deep], e[deep], far[deep]
            ring, s, e = np.concatenate([ring, ring]), np.concatenate([s, far]), np.concatenate([far, e])
    ring, place = np.unique(np.concatenate(found, axis=1), axis=1)
    return ring, place


def _farthest_from(r: Rings, rings: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The place of the point of each ring that is farthest from its point i, the first of equals."""
    n = r.size[rings]
    group, k = _flat(n)
    (ax, ay), (bx, by) = r.point(rings[group], i[group]), r.point(rings[group], k)
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    hit = np.flatnonzero(square == np.maximum.reduceat(square, np.cumsum(n) - n)[group])
    _, once = np.unique(group[hit], return_index=True)
    return k[hit[once]]


def signed_squares(r: Rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The squared distance of a point for each ring to its border, negative outside; of a ring without
    points minus infinity."""
    out = np.full(len(r), -np.inf)
    rings = np.flatnonzero(r.whole & (r.size > 0))
    if not len(rings):
        return out
    n = r.size[rings]
    group, k = _flat(n)
    of = rings[group]
    (ax, ay), (bx, by), x, y = r.point(of, k), r.point(of, k + 1), x[of], y[of]
    dx, dy, px, py = bx - ax, by - ay, x - ax, y - ay
    along, length, side = px * dx + py * dy, dx * dx + dy * dy, dx * py - dy * px
    ends = np.minimum(px * px + py * py, (x - bx) * (x - bx) + (y - by) * (y - by))
    on = (length > 0) & (along >= 0) & (along <= length)
    near = np.where(on, side * side / np.where(on, length, 1.0), ends)
    crosses = ((ay > y) != (by > y)) & np.where(by > ay, side > 0, side < 0)
    first = np.cumsum(n) - n
    far, odd = np.minimum.reduceat(near, first), np.add.reduceat(crosses.astype(np.int64), first) % 2 == 1
    out[rings] = np.where(odd, far, -far)
    return out


def runs(r: Rings, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ring, row, s, e) of the cells of rows 0 to ``height`` whose middles lie in rings, by ring and row.

    A row's middle line crosses the edges of a ring in an even number of places; cells between the
    first and the second, the third and the fourth, ... are inside."""
    of, k = _flat(np.where(r.whole, r.size, 0))
    (ax, ay), (bx, by) = r.point(of, k), r.point(of, k + 1)
    low, high = (np.clip(np.ceil(f(ay, by) - 0.5), 0, height).astype(np.int64) for f in (np.minimum, np.maximum))
    edge, k = _flat(high - low)
    row = low[edge] + k
    y = row + 0.5
    x = ax[edge] + (y - ay[edge]) * (bx[edge] - ax[edge]) / (by[edge] - ay[edge])
    ring = of[edge]
    order = np.lexsort((x, row, ring))
    ring, row, cell = ring[order], row[order], np.maximum(0, np.ceil(x[order] - 0.5)).astype(np.int64)
    ring, row, s, e = ring[::2], row[::2], cell[::2], cell[1::2]
    some = s < e
    return ring[some], row[some], s[some], e[some]
