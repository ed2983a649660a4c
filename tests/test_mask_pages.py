"""Masks of many pages at once against sets of cells, and what is sent for them."""

import random
import re

import numpy as np
import pytest

from leafmill.functions import maskarrays as ma
from leafmill.operators import masks as mk
from leafmill.plans import masked
from tests.test_masks import STEPS, H, W, block, flood, parts_of, runs_of

rng = random.Random(5)
NOISE = [[{(x, y) for x in range(W) for y in range(H) if rng.random() < p} for p in q] for q in ([0.1, 0.3, 0.5, 0.6, 0.7, 0.95, 0, 0.4], [0.5, 0.02, 0.5, 0.4, 0.3, 0.9, 0.5, 0])]


def runs(masks):
    rows = [(g, *r) for g, cells in enumerate(masks) for r in runs_of(cells)]
    return ma.Runs(*np.array(rows, np.int64).reshape(-1, 4).T)


def cells(found, n=len(NOISE[0])):
    out = [set() for _ in range(n)]
    for g, y, s, e in zip(*(v.tolist() for v in found)):
        assert s < e and not {(x, y) for x in range(s - 1, e + 1)} & out[g]  # maximal, and once
        out[g] |= {(x, y) for x in range(s, e)}
    return out


def test_set_operations_growth_and_parts():
    a, b = NOISE
    for of, want in ((ma.both, set.__and__), (ma.without, set.__sub__), (ma.either, set.__or__)):
        assert cells(of(runs(a), runs(b))) == [want(x, y) for x, y in zip(a, b)]
    near = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) <= 2]
    assert cells(ma.grown(runs(a), 2)) == [{(x + dx, y + dy) for x, y in c for dx, dy in near} for c in a]
    for corners in (True, False):
        r = runs(a)
        part = ma.parts(r, corners)
        for g, c in enumerate(a):
            mine = [set().union(*({(x, int(r.row[i])) for x in range(r.s[i], r.e[i])} for i in np.flatnonzero((part == p) & (r.group == g)))) for p in set(part[r.group == g])]
            assert {frozenset(x) for x in mine} == set(parts_of(c, corners))


def test_regions_and_holes():
    a, _ = NOISE
    seeds = [(g, rng.randrange(-2, W + 2), rng.randrange(-2, H + 2)) for g in range(len(a)) for _ in range(4)]
    got = cells(ma.reached(runs(a), ma.points(*np.array(seeds).T)))
    assert got == [flood(c, [(x, y) for k, x, y in seeds if k == g], STEPS) for g, c in enumerate(a)]
    frame = {(x, y) for x in range(-1, W + 1) for y in range(-1, H + 1)}
    for c, found in zip(a, cells(ma.holes(runs(a), 6))):
        assert found == {p for part in parts_of(frame - c, False) if len(part) < 6 and (-1, -1) not in part and all(min(x for x, _ in c) <= x <= max(x for x, _ in c) and min(y for _, y in c) <= y <= max(y for _, y in c) for x, y in part) for p in part}
    none = runs([])
    assert not len(ma.grow_selection(none, none, none, none, 9).s) and not len(ma.scissors(none, none, none, 9, 0.1)[0])


def test_scissors_and_selections():
    whole = block(0, 0, 40, 20)
    masks = [whole, whole, whole, block(0, 0, 6, 6), whole]
    strokes = [block(18, 0, 20, 20), block(18, 0, 20, 12), block(12, 0, 13, 20) | block(26, 0, 27, 20), set(), block(36, 0, 37, 20)]
    lines = ma.points(*np.array([(0, 5, 5), (0, 30, 5), (0, 18, 5), (0, 19, 5), (0, 60, 5), (1, 5, 5)]).T)
    group, size, n, side = ma.scissors(runs(masks), runs(strokes), lines, mk.DUST_CELLS, mk.DUST_SHARE)
    assert (group.tolist(), size.tolist(), n.tolist()) == ([0, 1, 2, 3, 4], [800, 800, 800, 36, 800], [2, 1, 3, 0, 1])
    assert side.tolist() == [1, 2, 1, 2, 0, 0]
    field, mask, wall, hole = block(0, 0, 30, 20), block(4, 4, 8, 8), block(15, 0, 16, 20), {(10, 10), (11, 10)}
    seeds = ma.points(*np.array([(0, 9, 5), (1, 20, 5)]).T)
    got = ma.grow_selection(runs([mask, mask]), runs([field - hole, field]), runs([wall, wall]), seeds, mk.HOLE_CELLS)
    assert cells(got, 2) == [block(0, 0, 15, 20), mask]


@pytest.mark.parametrize("name", ["mask_operations", "region_reached", "selection_grown", "scissors_cut"])
def test_only_shapes_are_sent_and_nothing_is_written(spark, sf, name, monkeypatch):
    """Runs were sent by page and row, many times as many bytes as the shapes they come from, and written."""
    monkeypatch.setattr(mk, "settled", lambda df, label: pytest.fail(label))
    plan = getattr(masked, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert sent and all(re.fullmatch(r"(page_id|o_orderkey|l_orderkey)#\d+L?", k) for k in sent), sent
    assert len(sent) <= 3
