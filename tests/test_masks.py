"""Masks of runs against sets of cells."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import masks as mk

W, H = 24, 18
STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0))


def runs_of(cells):
    out = []
    for x, y in sorted(cells, key=lambda c: (c[1], c[0])):
        if out and out[-1][0] == y and out[-1][2] == x:
            out[-1][2] = x + 1
        else:
            out.append([y, x, x + 1])
    return [tuple(r) for r in out]


def frame(spark, masks):
    return spark.createDataFrame([(k, *r) for k, cells in masks.items() for r in runs_of(cells)], "k int, row int, s int, e int")


def cells_by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, []).append((r.row, r.s, r.e))
    return {k: sorted(v) for k, v in out.items()}


def flood(field, seeds, steps=STEPS):
    """A frontier that goes on until nothing is new."""
    seen, front = set(), {c for c in seeds if c in field}
    while front:
        seen |= front
        front = {(x + dx, y + dy) for x, y in front for dx, dy in steps} & field - seen
    return seen


def parts_of(cells, corners):
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)] if corners else STEPS
    left, out = set(cells), []
    while left:
        part = flood(left, {min(left, key=lambda c: (c[1], c[0]))}, steps)
        out.append(frozenset(part))
        left -= part
    return out


@pytest.fixture(scope="module")
def some():
    rng = random.Random(8)
    noise = lambda p: {(x, y) for x in range(W) for y in range(H) if rng.random() < p}
    a = {k: noise(p) for k, p in enumerate([0.1, 0.3, 0.5, 0.6, 0.7, 0.95])}
    b = {k: noise(p) for k, p in enumerate([0.5, 0.02, 0.5, 0.4, 0.3, 0.9])}
    return a | {9: {(1, 1)}}, b | {10: {(2, 2)}}


def test_set_operations(spark, some):
    a, b = some
    fa, fb = frame(spark, a), frame(spark, b)
    for got, of in ((mk.both, lambda x, y: x & y), (mk.without, lambda x, y: x - y), (mk.either, lambda x, y: x | y)):
        want = {k: runs_of(c) for k in a.keys() | b.keys() if (c := of(a.get(k, set()), b.get(k, set())))}
        assert cells_by_key(got(fa, fb, ["k"])) == want


def test_runs_that_overlap_or_touch_become_one(spark):
    df = spark.createDataFrame([(1, 0, 0, 4), (1, 0, 4, 6), (1, 0, 2, 3), (1, 0, 7, 8), (1, 1, 0, 1), (1, 0, 7, 8)], "k int, row int, s int, e int")
    assert cells_by_key(mk.joined(df, ["k"])) == {1: [(0, 0, 6), (0, 7, 8), (1, 0, 1)]}
    assert cells_by_key(mk.either(df, df, ["k"])) == {1: [(0, 0, 6), (0, 7, 8), (1, 0, 1)]}


@pytest.mark.parametrize("corners", [True, False])
def test_connected_parts(spark, some, corners):
    a, _ = some
    got = {}
    for r in mk.parts(frame(spark, a), ["k"], corners).collect():
        got.setdefault((r.k, r.part), set()).update((x, r.row) for x in range(r.s, r.e))
    for k, cells in a.items():
        assert {frozenset(c) for (kk, _), c in got.items() if kk == k} == set(parts_of(cells, corners))


def test_a_region_is_the_fixpoint_of_its_frontier(spark, some):
    a, _ = some
    rng = random.Random(1)
    seeds = {k: [(rng.randrange(W), rng.randrange(H)) for _ in range(3)] for k in a}
    points = spark.createDataFrame([(k, x, y) for k, s in seeds.items() for x, y in s], "k int, x int, y int")
    want = {k: runs_of(c) for k in a if (c := flood(a[k], seeds[k]))}
    assert cells_by_key(mk.reached(frame(spark, a), points, ["k"])) == want


def test_growth_by_steps_and_holes(spark, some):
    a, _ = some
    want = {k: runs_of({(x + dx, y + dy) for x, y in c for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) <= 2}) for k, c in a.items()}
    assert cells_by_key(mk.grown(frame(spark, a), ["k"], 2)) == want
    frames = {(x, y) for x in range(-1, W + 1) for y in range(-1, H + 1)}
    enclosed = {}
    for k, c in a.items():
        inner = {p for part in parts_of(frames - c, False) if len(part) < 6 and not any(x in (-1, W) or y in (-1, H) for x, y in part) for p in part}
        box = (min(x for x, _ in c), max(x for x, _ in c), min(y for _, y in c), max(y for _, y in c))
        inner = {p for p in inner if box[0] <= p[0] <= box[1] and box[2] <= p[1] <= box[3]}
        if inner:
            enclosed[k] = runs_of(inner)
    assert cells_by_key(mk.holes(frame(spark, a), ["k"], 6)) == enclosed


def test_rings_and_boxes(spark):
    ring = [[2.0, 1.0], [10.0, 1.0], [10.0, 9.0], [6.0, 5.0], [2.0, 9.0]]
    got = cells_by_key(mk.from_rings(spark.createDataFrame([(1, ring)], "k int, ring array<array<double>>"), ["k"], 20))[1]

    def inside(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x > ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    want = {(x, y) for x in range(20) for y in range(20) if inside(x + 0.5 + 1e-9, y + 0.5)}
    assert got == runs_of(want)
    boxes = spark.createDataFrame([(1, 0, 0, 2, 2), (1, 1, 1, 4, 3), (1, 5, 5, 5, 9)], "k int, x0 int, y0 int, x1 int, y1 int")
    assert cells_by_key(mk.from_boxes(boxes, ["k"]))[1] == [(0, 0, 2), (1, 0, 4), (2, 1, 4)]


def block(x0, y0, x1, y1):
    return {(x, y) for x in range(x0, x1) for y in range(y0, y1)}


def test_scissors(spark):
    whole = block(0, 0, 40, 20)
    masks = {1: whole, 2: whole, 3: whole, 4: block(0, 0, 6, 6), 5: whole}
    strokes = {1: block(18, 0, 20, 20), 2: block(18, 0, 20, 12), 3: block(12, 0, 13, 20) | block(26, 0, 27, 20), 5: block(36, 0, 37, 20)}
    lines = [(1, 1, 5, 5), (1, 2, 30, 5), (1, 3, 18, 5), (1, 4, 19, 5), (1, 5, 60, 5), (2, 1, 5, 5)]
    verdicts, dealt = mk.scissors(frame(spark, masks), frame(spark, strokes), spark.createDataFrame(lines, "k int, seq int, x int, y int"), ["k"])
    assert {r.k: (r.n_parts, r.verdict) for r in verdicts.collect()} == {1: (2, "cut"), 2: (1, "not through"), 3: (3, "too many"), 4: (0, "too small"), 5: (1, "not through")}
    # the seam, two cells wide, goes back to both sides, a cell each
    assert {r.seq: r.side for r in dealt.collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: None}
    _, thin = mk.scissors(frame(spark, {1: whole}), frame(spark, {1: block(18, 0, 19, 20)}), spark.createDataFrame([(1, 1, 18, 5), (1, 2, 17, 5)], "k int, seq int, x int, y int"), ["k"])
    assert {r.seq: r.side for r in thin.collect()} == {1: None, 2: 1}  # on the seam both sides hold it


def test_a_selection_grows_up_to_its_barrier(spark):
    field = block(0, 0, 30, 20)
    mask, wall = block(4, 4, 8, 8), block(15, 0, 16, 20)
    hole = {(10, 10), (11, 10)}
    one = lambda cells: frame(spark, {1: cells})
    seeds = spark.createDataFrame([(1, 9, 5)], "k int, x int, y int")
    got = cells_by_key(mk.grow_selection(one(mask), one(field - hole), one(wall), seeds, ["k"]))[1]
    assert got == runs_of(block(0, 0, 15, 20))
    far = spark.createDataFrame([(1, 20, 5)], "k int, x int, y int")
    assert cells_by_key(mk.grow_selection(one(mask), one(field), one(wall), far, ["k"]))[1] == runs_of(mask)  # beyond the wall, and not near


def test_runs_of_many_rings_at_once(spark):
    """Odd rings among others: null, without points, outside of the rows, crossing itself."""
    rings = [None, [], [[0.0, -9.0], [4.0, -9.0], [4.0, -2.0]], [[0.0, 0.0], [8.0, 0.0], [0.0, 4.0], [8.0, 4.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 50.0], [1.0, 50.0]]]
    got = cells_by_key(mk.from_rings(spark.createDataFrame(list(enumerate(rings)), "k int, ring array<array<double>>"), ["k"], 3))
    assert got == {3: [(0, 1, 7), (1, 3, 5), (2, 3, 5)], 4: [(1, 1, 3), (2, 1, 3)]}
    plan = mk.from_rings(spark.createDataFrame([(1, rings[3])], "k int, ring array<array<double>>"), ["k"], 3)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan  # a fold a row took most of the time
